"""The registered queries against their SQL in DuckDB, and the pipeline against its stages, on the smallest tables."""

import os

import duckdb
import pytest

from sigframe.llm import registry

TABLES = "/root/testdata/sf0.001"
NAMES = "documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in NAMES:
        duck.sql(f"create view {t} as select * from '{TABLES}/{t}.parquet'")
    got, want = registry.queries()[name](spark, TABLES).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and [str(t) for t in got[columns].dtypes] == [str(t) for t in want[columns].dtypes]
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want) and all((got[c] == want[c]).all() for c in columns)


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))


def test_pipeline(spark, tmp_path):
    """Each stage by brute force on what the one before it kept."""
    import hashlib
    import re

    import numpy as np
    import public_tokenizers
    import tiktoken

    import corpus_pipeline
    from sigframe.llm import op7_bpe

    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    columns, stages = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, TABLES).write.parquet(str(tmp_path / name.replace(" ", "")))
        before, docs = docs, spark.read.parquet(str(tmp_path / name.replace(" ", "")))
        stages[name] = before.toPandas(), docs.toPandas()
        assert docs.columns == columns or name == "tokens"
    marked = spark.read.parquet(f"{TABLES}/labels.parquet").toPandas().set_index("doc_id").toxic
    before, after = stages["toxicity"]
    gone = set(before.doc_id) - set(after.doc_id)
    assert sum(marked.get(i, 1) == 0 for i in gone) <= 2  # clean documents stay
    before, after = stages["near-duplicates"]
    sets = {}
    for r in before.itertuples():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    ids, first = sorted(sets), {i: i for i in sets}
    find = lambda x: x if first[x] == x else find(first[x])
    for x in ids:
        for y in ids:
            both = len(sets[x] & sets[y])
            if x < y and both and 5 * both >= 4 * (len(sets[x]) + len(sets[y]) - both):
                a, b = find(x), find(y)
                first[max(a, b)] = min(a, b)
    assert sorted(after.doc_id) == [i for i in ids if find(i) == i]
    before, after = stages["personal data"]
    assert sorted(before.doc_id) == sorted(after.doc_id) and not after.text.str.contains(r"[a-z0-9]@[a-z0-9]+\.[a-z]").any()
    before, after = stages["mixing"]
    size = before.set_index("doc_id").text.str.findall(r"[^\x20\x09-\x0D]+").str.len()
    taken = after.text.str.findall(r"[^\x20\x09-\x0D]+").str.len().groupby(after.doc_id).sum()
    assert (taken <= 3 * size[taken.index]).all() and abs(taken.sum() / size.sum() - 1) < 0.05
    before, after = stages["tokens"]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=op7_bpe.load(public_tokenizers.path(op7_bpe.VOCABULARY)), special_tokens={})
    want = sorted((i, hashlib.sha256(np.array(library.encode_ordinary(t), "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in zip(before.doc_id, before.text))
    assert sorted(zip(after.doc_id, after.ids_sha256, after.decoded_sha256)) == want
    assert corpus_pipeline.run(spark, TABLES).count() == len(after)


def test_pipeline_edges(spark):
    """Each stage on nulls, empty and long texts, repeated rows, clashing columns, and no rows."""
    import corpus_pipeline

    rows = [(900, None), (901, ""), (902, " \n\t "), (903, "word"), (903, "word"), (904, "two words"), (None, "one id is null"), (None, "one id is null"), (None, "another text"), (905, "é " * 30_000), (906, "x" * 200_000),
            (907, "a b c d e f g h i j " * 40), (907, "a b c d e f g h i j " * 40), (908, "write to a@b.org or +1 555 123 4567 now")]
    kind = "doc_id long, text string, lang string, source string, n_chars long, k string, th long, row string, node string, part string, _salt int, toxic string"
    full = [(i, t, None if n % 2 else "en", [None, "a", "b"][n % 3], len(t or ""), "k", 5, "r", "n", "p", 3, "t") for n, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(full, kind).repartition(3)
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, TABLES)
        assert name == "tokens" or out.columns == docs.columns and [(c, t) for c, t in out.dtypes] == docs.dtypes
        counts[name] = out.collect()
        assert stage(spark, docs.where("false"), TABLES).count() == 0
    assert len(counts["toxicity"]) == len(counts["personal data"]) == len(counts["tokens"]) == len(rows)
    assert sorted(r.doc_id or 0 for r in counts["near-duplicates"]) == [0, 0, 900, 901, 902, 903, 904, 905, 906, 907, 908]
    assert [r.text for r in counts["personal data"] if r.doc_id == 908] == ["write to [EMAIL] or [PHONE] now"] and any(r.text is None for r in counts["personal data"])
    assert all(r.text and r.text.strip() for r in counts["mixing"]) and all(r.n_chars == len(r.text) for r in counts["mixing"])
    assert {r.n_tokens for r in counts["tokens"] if r.doc_id in (900, 901)} == {0}
