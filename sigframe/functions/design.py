"""Butterworth filters as second-order sections, by the textbook way: poles of the analogue low-pass, band
transformation, bilinear transformation, pairs of poles and zeros."""

from __future__ import annotations

import numpy as np


def butterworth_bandpass(order: int, low: float, high: float) -> np.ndarray:
    """Sections (b0, b1, b2, 1, a1, a2) of a band-pass of 2 * order poles; low < high in cycles per sample, below 0.5."""
    if order < 1 or not 0 < low < high < 0.5:
        raise ValueError("order must be positive and 0 < low < high < 0.5")
    w1, w2 = (2 * np.tan(np.pi * f) for f in (low, high))
    centre, width = np.sqrt(w1 * w2), w2 - w1
    k = np.arange(1, order + 1)
    prototype = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order))
    half = prototype * width / 2
    root = np.sqrt(half**2 - centre**2 + 0j)
    analogue = np.concatenate((half + root, half - root))
    poles = (2 + analogue) / (2 - analogue)
    upper = sorted(poles[poles.imag > 1e-14], key=abs)
    real = sorted(poles[np.abs(poles.imag) <= 1e-14].real)
    pairs = [(-2 * p.real, abs(p) ** 2) for p in upper] + [(-(a + b), a * b) for a, b in zip(real[::2], real[1::2])]
    at = np.exp(2j * np.pi * np.arctan(centre / 2) / np.pi)  # the centre's place on the unit circle
    sections = []
    for a1, a2 in pairs:  # each section takes a zero at 1 and one at -1, and has gain 1 at the centre
        gain = abs((1 + a1 / at + a2 / at**2) / (1 - 1 / at**2))
        sections.append((gain, 0.0, -gain, 1.0, a1, a2))
    return np.array(sections)
