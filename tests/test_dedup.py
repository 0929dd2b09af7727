import hashlib

from pyspark.sql import functions as F

from corpusflow.operators.dedup import PRIME, first_wins_dedup, lsh_params, minhash_coefficients

from conftest import SF0001


def brute_force_keep(rows, k=3, threshold=0.8):
    """Sequential insert-then-query over band keys, in order (reference semantics)."""
    b, r = lsh_params(threshold)
    coeffs = minhash_coefficients(b * r)
    index = [dict() for _ in range(b)]
    kept = []
    for ord_, text in rows:
        w = (text or "").strip().lower().split()
        sh = {" ".join(w[i:i + k]) for i in range(len(w) - k + 1)}
        hs = [int(hashlib.md5(s.encode()).hexdigest()[:7], 16) for s in sh]
        sig = [min(((h * a + c) % PRIME for h in hs), default=PRIME) for a, c in coeffs]
        keys = [tuple(sig[j * r:(j + 1) * r]) for j in range(b)]
        for j, key in enumerate(keys):
            index[j].setdefault(key, []).append(ord_)
        result = {o for j, key in enumerate(keys) for o in index[j][key]}
        if result == {ord_}:
            kept.append(ord_)
    return kept


def test_params():
    assert lsh_params(0.8) == (9, 13)
    assert lsh_params(0.5) == (25, 5)


def test_matches_brute_force_on_small_table(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = sorted(r.doc_id for r in first_wins_dedup(docs, "doc_id", "text").collect())
    assert got == brute_force_keep(rows)


def test_copies_chain_and_short_rows(spark):
    base = "the quick brown fox jumps over the lazy dog near the river bank today"
    rows = [(1, base), (2, base), (3, base.upper()), (4, "tiny"), (5, "also tiny"), (6, ""),
            (7, "completely different words appear in this sentence for sure now")]
    df = spark.createDataFrame(rows, "id bigint, t string")
    kept = sorted(r.id for r in first_wins_dedup(df, "id", "t").collect())
    assert kept == [1, 4, 7]
    kept2 = sorted(r.id for r in first_wins_dedup(df, "id", "t", short="keep").collect())
    assert kept2 == [1, 4, 5, 6, 7]


def test_idempotent_and_partition_free(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text")
    once = first_wins_dedup(docs, "doc_id", "text")
    twice = first_wins_dedup(once, "doc_id", "text")
    shuffled = first_wins_dedup(docs.repartition(7), "doc_id", "text")
    a = sorted(r.doc_id for r in once.collect())
    assert a == sorted(r.doc_id for r in twice.collect()) == sorted(r.doc_id for r in shuffled.collect())


def test_aggregate_method_equals_vectorized(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text")
    a = sorted(r.doc_id for r in first_wins_dedup(docs, "doc_id", "text", method="aggregate").collect())
    b = sorted(r.doc_id for r in first_wins_dedup(docs, "doc_id", "text").collect())
    assert a == b


def test_repeated_or_null_order_fails(spark):
    import pytest
    from corpusflow.operators.dedup import first_wins_dedup
    for rows in ([(1, "a b c d"), (1, "e f g h")], [(None, "a b c d"), (2, "e f g h")]):
        with pytest.raises(Exception, match="unique and not NULL"):
            first_wins_dedup(spark.createDataFrame(rows, "ord bigint, t string"), "ord", "t").collect()


def test_minhash_kernel_is_exact_without_divisions():
    """Packed hashes (4 bytes a shingle), the extreme ones and products that are multiples of the modulus among them."""
    import numpy as np
    import pandas as pd

    from corpusflow.operators.dedup import _minhash_udf
    coeffs = [*minhash_coefficients(115), (PRIME - 1, PRIME - 1), (1, PRIME - 5)]
    rng = np.random.default_rng(1)
    sets = [[0], [5], [2**28 - 1], [0, 1, 2**28 - 1], [int(x) for x in rng.integers(0, 2**28, 1000)]]
    packed = [b"".join(((h << 4) | 9).to_bytes(4, "big") for h in s) for s in sets]
    got = _minhash_udf(coeffs).func(pd.Series([*packed, b"", None]))
    for s, sig in zip(sets, got):
        assert list(sig) == [min((h * a + b) % PRIME for h in s) for a, b in coeffs]
    assert all(list(sig) == [PRIME] * len(coeffs) for sig in got[-2:])


def test_packed_hashes_and_all_shingles(spark):
    from corpusflow.functions.text import all_shingles, packed_hashes, shingle_hashes, shingles, word_ngrams, words
    texts = ["", None, "one two", " A b\tc d  a B c ", "İx ΣΣ 　 z\x1cy q w e r", "a a a a a a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(shingle_hashes(shingles("t", 3)).alias("h"), packed_hashes(shingles("t", 3)).alias("p"), all_shingles("t", 3).alias("s"),
                       word_ngrams(words(F.lower("t")), 3).alias("w")).collect():
        p = bytes(r["p"] or b"")
        assert [int.from_bytes(p[i:i + 4], "big") >> 4 for i in range(0, len(p), 4)] == r["h"]
        assert r["s"] == r["w"]
