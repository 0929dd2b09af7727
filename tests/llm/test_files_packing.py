"""Token files, packing and decontamination against brute force, with edge rows."""
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusflow.llm import decontaminate, packing, token_files

from test_exact_near import edge_rows, frame

WORD = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name):
    path = public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        e = token_files.Encoder(f.read())
    assert e.by_word == (name == "word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rng = random.Random(1)
    chars = "abzAZ019.,!'\"|<>&-_ \t\n\r\x0b\x1c\x85 ßéÉÿÑœŒΣσİ́漢😀²Ⅷ٣"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += ["", "a<|endoftext|>b <|startoftext|>", "don't I'LL we're x's'", "x" * 500, "ÀÖØÞ größe straße", " lead  and trail "]
    for at in range(0, len(texts), 100):
        part = texts[at:at + 100]
        for text, got in zip(part, e(part)):
            assert np.frombuffer(got, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "MEMO_PIECES", 20)
    monkeypatch.setattr(token_files, "MEMO_WORDS", 20)
    with open(WORD, encoding="utf-8") as f:
        e = token_files.Encoder(f.read())
    t = Tokenizer.from_file(WORD)
    for i in range(20):
        texts = [" ".join(f"word{chr(97 + j % 26)}{chr(97 + i)}," for j in range(15)), "y" * 100]
        assert [np.frombuffer(x, "<u4").tolist() for x in e(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert len(e.memo) < 60 and "y" * 100 not in e.memo and "y" * 100 not in e.words


def test_files_round_trip(spark, tmp_path):
    rows = edge_rows() + [(100 + i, f"text number {i} " * (i % 7)) for i in range(300)]
    docs = frame(spark, rows).repartition(5)
    manifest = token_files.write(docs, str(tmp_path / "tokens"), WORD, seq_len=64)
    files = manifest.collect()
    got = defaultdict(list)
    for r in token_files.read(manifest, len(files)).collect():
        got[r.doc_id].append((r.start, r.n_tokens, r.ids_crc32))
    t = Tokenizer.from_file(WORD)
    ids = {i: sorted(zlib.crc32(np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for j, x in rows if j == i)
           for i, _ in rows}
    assert {i: sorted(c for _, _, c in v) for i, v in got.items()} == ids
    flat = sorted((s, n, (d is not None, d or 0)) for d, v in got.items() for s, n, _ in v)
    assert [s for s, _, _ in flat] == np.cumsum([0] + [n for _, n, _ in flat])[:-1].tolist()
    assert [d for _, _, d in flat] == sorted(d for _, _, d in flat)
    f = files[0]
    tokens = token_files.open_file(f.tokens_file)
    one, mask = token_files.sequence(tokens, 0)
    batch = tokens.get_batch(0).column("ids").flatten().to_numpy(zero_copy_only=True)
    assert len(one) == len(mask) == 64 and one.dtype == np.uint16 and (one == batch[:64]).all()
    last, mask = token_files.sequence(tokens, -(-f.n_tokens // 64) - 1)
    assert mask.true_count == f.n_tokens - (-(-f.n_tokens // 64) - 1) * 64
    # files of an attempt that the manifest does not name are never read
    (tmp_path / "tokens" / "000000-lost.tokens.arrow").write_bytes(b"broken")
    assert token_files.read(manifest, len(files)).count() == len(rows) and os.path.exists(f.docs_file)
    none = token_files.write(frame(spark, []), str(tmp_path / "none"), WORD)
    assert none.count() == 0 and token_files.read(none, 0).count() == 0


def test_pack_invariants_and_quality():
    rng = random.Random(2)
    for trial in range(60):
        permitted = rng.choice([(8, 16, 32), (10,), (512, 1024, 2048, 4096)])
        lengths = [rng.randrange(1, max(permitted) + 1) for _ in range(rng.randrange(0, 80))]
        bins, offsets, sizes = packing.pack(lengths, permitted)
        held = defaultdict(list)
        for i, b in enumerate(bins):
            held[b].append(i)
        for b, own in held.items():
            total, size = sum(lengths[i] for i in own), sizes[own[0]]
            assert {sizes[i] for i in own} == {size} and size == min(c for c in permitted if c >= total)
            at = 0
            for i in sorted(own, key=lambda i: offsets[i]):
                assert offsets[i] == at
                at += lengths[i]
        # never dearer than giving each piece a sequence of its own
        own = sum(packing.cost(min(c for c in permitted if c >= n)) for n in lengths)
        assert sum(packing.cost(sizes[v[0]]) for v in held.values()) <= own + 1e-9


def best_cost(lengths, permitted):
    """Exact optimum over all partitions into bins (tiny inputs)."""
    best = [float("inf")]

    def place(i, bins):
        if i == len(lengths):
            best[0] = min(best[0], sum(packing.cost(min(c for c in permitted if c >= b)) for b in bins))
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= max(permitted):
                place(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1:]])
        place(i + 1, [*bins, lengths[i]])
    place(0, [])
    return best[0]


def test_pack_is_near_the_optimum():
    rng = random.Random(7)
    ratio = []
    for _ in range(40):
        permitted = (512, 1024, 2048)
        lengths = [rng.randrange(40, 1500) for _ in range(7)]
        bins, _, sizes = packing.pack(lengths, permitted)
        ratio.append(sum(packing.cost(s) for s in {b: s for b, s in zip(bins, sizes)}.values()) / best_cost(lengths, permitted))
    assert min(ratio) >= 1 - 1e-9 and np.mean(ratio) < 1.08 and max(ratio) < 1.4


def test_packing_frames(spark):
    docs = frame(spark, edge_rows())
    got = packing.best_fit(docs, permitted=(64, 256), shard_rows=40).collect()
    want = defaultdict(int)
    for i, t in edge_rows():
        want[i] += len((t or "").split()) + 1
    have, bins = defaultdict(int), defaultdict(int)
    for r in got:
        have[r.doc_id] += r.length
        bins[r.shard, r.bin, r.bin_length] += r.length
    assert have == want and all(n <= size for (_, _, size), n in bins.items()) and len({r.shard for r in got}) > 1
    assert len({(r.doc_id, r.copy, r.start) for r in got if r.doc_id not in (None,)}) == sum(r.doc_id is not None for r in got)
    assert packing.best_fit(frame(spark, [])).count() == 0


def test_packing_keeps_large_ids_beside_null(spark):
    ids = [None, 9007199254740993, 9007199254740995, -9007199254740993]
    got = packing.best_fit(frame(spark, [(i, "a b c") for i in ids]))
    assert sorted((r.doc_id for r in got.collect()), key=str) == sorted(ids, key=str)


def items(n=40, seed=9):
    rng = random.Random(seed)
    return [(i, " ".join("".join(rng.choice("aeioutnrsh") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(18, 60)))) for i in range(n)]


def slow_distance(a, b):
    prev = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j - 1] + (x != y), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


def test_distance_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(400):
        a = "".join(rng.choice("ab é") for _ in range(rng.randrange(1, 14)))
        b = "".join(rng.choice("ab é") for _ in range(rng.randrange(0, 22)))
        assert decontaminate.distance(a, b) == slow_distance(a, b)


def test_recall_and_precision_against_brute_force():
    bench, rng, np_rng = items(), random.Random(4), np.random.default_rng(4)
    index = decontaminate.Index([(i, decontaminate.normal(t)) for i, t in bench], decontaminate.repetitions([t for _, t in bench]))
    found = total = 0
    for trial in range(240):
        i, t = bench[trial % len(bench)]
        around = items(2, 1000 + trial)
        k = rng.randrange(0, int(0.16 * len(t)))
        text = f"{around[0][1]} {decontaminate.edited(t, k, np_rng)} {around[1][1]}"
        want = {j: d for j, u in bench if (d := decontaminate.distance(decontaminate.normal(u), decontaminate.normal(text))) <= int(0.1 * len(decontaminate.normal(u)))}
        got = {j: d for j, d, _ in index.matches(text)}
        assert all(want.get(j) == d for j, d in got.items())
        found, total = found + len(got), total + len(want)
    assert total > 100 and found / total >= 0.97
    assert not any(index.matches(t) for _, t in items(60, 77))


def test_recall_of_edits_on_any_character():
    found = total = 0
    for n, (_, t) in enumerate(items(24, 12)):
        for c in "?~ü":
            for at in (0, 2, 5, 20):
                item = t[:at] + c + t[at + 1:]
                index = decontaminate.Index([(n, item)], 32)
                for edit in (t[:at] + "." + t[at + 1:], t[:at] + t[at + 1:], item[:at] + c + item[at:]):
                    found, total = found + bool(index.matches(f"so {edit} then")), total + 1
    assert found / total >= 0.97


def test_every_window_is_verified_when_the_recall_is_not_reached(spark, monkeypatch):
    bench, rng = [(i, decontaminate.normal(t)) for i, t in items()], np.random.default_rng(8)
    assert decontaminate.repetitions([t for _, t in bench], target=1.01) == 0
    near = [(i, f"so {decontaminate.edited(t, int(0.1 * len(t)), rng)} then") for i, t in bench for _ in range(5)]
    want = sorted((i, j, d) for i, text in near for j, t in bench if (d := decontaminate.distance(t, decontaminate.normal(text))) <= int(0.1 * len(t)))
    monkeypatch.setattr(decontaminate.repetitions, "__defaults__", (0.1, 1.01, 5))
    found = decontaminate.find(spark.createDataFrame(near, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string"))
    assert sorted((r.doc_id, r.item_id, r.edit_distance) for r in found.collect()) == want and len(want) > 150


def test_decontamination_frames(spark):
    bench = items(6)
    rows = edge_rows() + [(50, "intro words " + bench[2][1].upper().replace(" ", "\n ") + " more"), (50, bench[2][1]), (51, bench[2][1][:60]),
                          (52, ("filler " * 30_000) + bench[4][1] + " " + bench[4][1])]
    marks = spark.createDataFrame([*bench, (99, None), (98, ""), (97, "one"), (96, bench[2][1])], "item_id bigint, text string")
    docs = frame(spark, rows)
    got = sorted((r.doc_id, r.item_id, r.edit_distance) for r in decontaminate.find(docs, marks, least=decontaminate.MIN_CHARS).collect())
    assert got == [(50, 2, 0), (50, 2, 0), (50, 96, 0), (50, 96, 0), (52, 4, 0)]
    kept = decontaminate.clean(docs, marks, least=decontaminate.MIN_CHARS)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert decontaminate.find(docs, marks.limit(0)).count() == 0 and decontaminate.find(docs.limit(0), marks).count() == 0


def test_short_items_match_verbatim(spark):
    bench = [(1, "What is  2 + 2?"), (2, "cat"), (3, "日本の首都"), (4, "naïve"), (5, ""), (6, None), (7, "x" * 24), (8, "x" * 25)]
    rows = [(1, "so what is 2\n+ 2? four"), (2, "concatenate cats"), (3, "a CAT, a cat"), (4, "今の日本の首都は"), (5, "naïvety"), (6, "(naïve)"),
            (7, "x" * 24), (8, "x" * 25), (9, "what is 2 + 3?"), (10, None), (11, "cat " * 50_000)]
    marks = spark.createDataFrame(bench, "item_id bigint, text string")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.item_id, r.edit_distance, r.item_chars) for r in decontaminate.find(docs, marks, least=1).collect())
    assert got == [(1, 1, 0, 14), (3, 2, 0, 3), (4, 3, 0, 5), (6, 4, 0, 5), (7, 7, 0, 24), (7, 8, 1, 25), (8, 8, 0, 25), (11, 2, 0, 3)]
    assert sorted(r.doc_id for r in decontaminate.clean(docs, marks.where("item_id < 8"), least=1).collect()) == [2, 5, 8, 9, 10]


def test_the_query_and_the_pipeline_match_short_items(spark, tmp_path):
    import corpus_pipeline
    from corpusflow.llm.queries import QUERIES
    docs = spark.createDataFrame([(1, "a red fox, here"), (2, "red foxes")], "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "Red fox")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [tuple(r) for r in QUERIES["op3_benchmark_decontamination"](spark, str(tmp_path)).collect()]
    assert got == [(1, 7, 0, 7)]
    assert [r.doc_id for r in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()] == [2]


def test_items_in_blocks(spark, monkeypatch):
    bench = items(6)
    marks = spark.createDataFrame(bench, "item_id bigint, text string")
    docs = frame(spark, [(i, f"so {t} then") for i, t in bench])
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 400)
    assert sum(1 for _ in decontaminate.blocks(marks, "item_id", "text")) > 2
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find(docs, marks).collect()) == [(i, i) for i in range(6)]
    assert decontaminate.clean(docs, marks).count() == 0


def test_item_table_with_the_names_of_the_documents(spark):
    """Items whose id column is named like the documents' id; none is left out by default, however short."""
    docs = frame(spark, [(1, "so the quick brown fox jumps over the lazy dog again"), (2, "nothing"), (3, "a tiny one")])
    items = spark.createDataFrame([(7, "quick brown fox jumps over the lazy dog"), (8, "tiny")], "doc_id bigint, text string")
    got = decontaminate.find(docs, items, item_col="doc_id")
    assert got.columns[:2] == ["doc_id", "item_doc_id"] and sorted((r.doc_id, r.item_doc_id) for r in got.collect()) == [(1, 7), (3, 8)]
    assert [r.doc_id for r in decontaminate.clean(docs, items, item_col="doc_id").collect()] == [2]
