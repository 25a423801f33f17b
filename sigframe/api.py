"""The names that users of chunk streams know, for signals.

Differences that Spark's model brings: positions are explicit; sizes of chunks matter only where a result shows them;
`tee`, `split` and `reusable` never make one branch wait for another; stores are Parquet folders, HDF5 is read where
h5py is installed.
"""

from sigframe.operators.fir import oaconvolve, upfirdn
from sigframe.operators.iir import sosfilt, sosfiltfilt
from sigframe.operators.mixing import add_brownian_noise, brownian_noise, mix
from sigframe.operators.reduce import length, mean, sum
from sigframe.operators.scan import cumsum, unwrap
from sigframe.operators.slicing import concatenate, enumerate, head, linspace, mapped, peek, reusable, reverse, sliceiter, split, start_after, stop_after, tee, zipped
from sigframe.operators.udf import apply, chain, normalize_bodyfun, per_entry
from sigframe.operators.windows import batchavg, combine_chunks, pre_rechunk, rechunk, sliding_window
from sigframe.signal import Signal, signal, with_index
from sigframe.sources.cache import cache, identified, multihash
from sigframe.sources.frames import IterableBinaryFileChunks, binaryfile_to_chunks, chunks_to_binaryfile, deserialize_ndarray, serialize_ndarray
from sigframe.sources.store import array_from_store, array_to_store, chunks_to_store, from_hdf5, stored

__all__ = [
    "IterableBinaryFileChunks", "Signal", "add_brownian_noise", "apply", "array_from_store", "array_to_store", "batchavg", "binaryfile_to_chunks", "brownian_noise", "cache", "chain", "chunks_to_binaryfile",
    "chunks_to_store", "combine_chunks", "concatenate", "cumsum", "deserialize_ndarray", "enumerate", "from_hdf5", "head", "identified", "length", "linspace", "mapped", "mean", "mix", "multihash",
    "normalize_bodyfun", "oaconvolve", "peek", "per_entry", "pre_rechunk", "rechunk", "reusable", "reverse", "serialize_ndarray", "signal", "sliceiter", "sliding_window", "sosfilt", "sosfiltfilt",
    "split", "start_after", "stop_after", "stored", "sum", "tee", "unwrap", "upfirdn", "with_index", "zipped",
]
