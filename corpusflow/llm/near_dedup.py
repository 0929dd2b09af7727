"""MinHash near-duplicate groups with fast similarity sketching.

A document is the set of its distinct ``k``-word shingles (ASCII letters
lower-cased, words separated by ASCII white space).  Documents whose sets have
Jaccard similarity of at least ``percent`` / 100 are linked; a group is a
connected component of links.

Method
  1. *Sketch* (one pass, per document).  ``coords`` coordinates are filled by
     rounds: in round i every shingle is hashed into one coordinate with a value
     that starts with i, and a coordinate keeps its least value.  After
     ``coords`` rounds, further rounds address one coordinate each, so every
     coordinate is filled; the share of equal coordinates of two sketches is
     concentrated around the similarity of the sets.
  2. *Sets.*  Documents with equal sets are merged first (aggregate on a
     128-bit digest of the sorted set), so copies never meet a join.
  3. *Banding.*  ``bands`` keys of ``rows`` coordinates each; sets that share a
     key are candidates.  A pair of similarity s is found with probability
     1 - (1 - s^rows)^bands (0.8: 1 - 5e-6).
  4. *Star rounds.*  In every bucket that still holds several components, the
     sets meet one hub (a different one each round); a set is compared with the
     hub it shares most buckets with.  Links are confirmed on the full sets and
     contract the components, so large groups of near copies shrink to few
     components without their pairs ever being listed.  Rounds go on while they
     still join a fair share of what they compare.
  5. *The rest.*  Buckets that still hold several components are compared in
     blocks of about ``BLOCK`` shingles.  Inside a task a pair is looked at once
     (in the first bucket both share), only if its sets are in different
     components, passes the sketches (one byte a coordinate, cut 5 standard
     deviations below the threshold) and is confirmed on the full sets; a link
     joins the task's components at once.  A task thus emits fewer links than it
     holds sets.  No bucket is capped: a larger one has more block pairs.

Full sets are 64-bit shingle hashes; two documents' sets hold far fewer than
2^32 values, so an accidental match inside a pair has probability below 1e-12.

Defined results: with fewer than ``k`` words the whole word sequence is one
shingle; NULL, empty or blank texts have an empty set, no links and stay; NULL
ids take no part (component NULL, kept); repeated rows get equal answers; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import salt, salted_lookup, staged
from corpusflow.llm.words import SLICE, cut, mix, word_hashes

SHINGLE_WORDS, PERCENT = 5, 80
ROWS, BANDS = 6, 40
# A block holds about this many shingles (4 MB of hashes); a set counts as LEAST_SIZE at least, so
# that the number of sets in a block is bounded too.
BLOCK, LEAST_SIZE = 500_000, 128
# Star rounds end when a round joins less than this share of the pairs it compares; the blocks do the rest.
LEAST_SHARE, MOST_ROUNDS = 0.2, 6
STEP = 1 << 17  # hashes a sketching step computes at a time
FILTER_BITS = 1 << 25
SALTS = 128

def _shingles(ids: np.ndarray, width: int) -> np.ndarray:
    n = max(0, len(ids) - width + 1)
    h = np.full(n, width, np.uint64)
    for j in range(width):
        h = mix(h ^ ids[j:j + n])
    return h


def shingle_sets(texts: list, k: int) -> list[np.ndarray]:
    """Sorted distinct ``k``-word shingle hashes of each whole text (a slice of at most about 1 MB at a time)."""
    out, at = [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or b"") <= SLICE):
            size += len(texts[end] or b"")
            end += 1
        part = [(t or b"").lower() for t in texts[at:end]]
        if size > 4 * SLICE:  # a single very long text
            ids = np.concatenate([np.empty(0, np.uint64), *(word_hashes(p)[2] for p in cut(part[0], SLICE))])
            bounds = [0, len(ids)]
        else:
            starts, _, ids = word_hashes(b"\n".join(part))
            bounds = np.searchsorted(starts, np.cumsum([0] + [len(p) + 1 for p in part])).tolist()
        whole = _shingles(ids, k)
        for s, e in zip(bounds, bounds[1:]):
            h = whole[s:e - k + 1].copy() if e - s >= k else _shingles(ids[s:e], max(1, e - s))
            h.sort()
            out.append(h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h)
        at = end
    return out


def sketches(sets: list[np.ndarray], coords: int) -> np.ndarray:
    """Fast similarity sketches (one row of ``coords`` values per set; the empty set has all ones).

    A value is (round << 32 | hash), so the least value of a coordinate comes
    from the first round that reached it.  Sets leave as soon as they are filled.
    """
    empty = np.uint64(np.iinfo(np.uint64).max)
    out = np.full((len(sets), coords), empty, np.uint64)
    own = [i for i, x in enumerate(sets) if len(x)]
    if not own:
        return out
    x = np.concatenate([sets[i] for i in own])
    doc = np.repeat(np.array(own), [len(sets[i]) for i in own])
    done, flat = 0, out.reshape(-1)
    while len(x) and done < 2 * coords:
        many = min(max(1, STEP // len(x)), 2 * coords - done) if done else 1
        rounds = np.arange(done, done + many, dtype=np.uint64)
        h = mix(x[None, :] ^ mix(rounds)[:, None])
        at = (((h >> np.uint64(32)) * np.uint64(coords)) >> np.uint64(32)).astype(np.int64)
        late = rounds >= coords
        if late.any():
            at[late] = (rounds[late] - np.uint64(coords)).astype(np.int64)[:, None]
        value = (rounds[:, None] << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        np.minimum.at(flat, (at + doc * coords).ravel(), value.ravel())
        done += many
        open_ = (out == empty).any(axis=1)[doc]
        x, doc = x[open_], doc[open_]
    return out


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """Per sketch one 64-bit key for each band of ``rows`` consecutive coordinates (band number included)."""
    v = values.reshape(len(values), values.shape[1] // rows, rows)
    h = np.broadcast_to(np.arange(v.shape[1], dtype=np.uint64), v.shape[:2])
    for j in range(rows):
        h = mix(h ^ v[:, :, j])
    return h.view(np.int64)


def _texts(col: pa.ChunkedArray | pa.Array) -> list:
    return col.cast(pa.binary()).to_pylist()


def _keys(sets: list[np.ndarray]) -> list:
    """128-bit digest of each sorted set (NULL for the empty one): the name of the set, whatever rows have it."""
    return [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]


def _sketches(k: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(_texts(b.column(1)), k)
            n = np.array([len(x) for x in sets], np.int64)
            keys = _keys(sets)
            flat = band_keys(sketches(sets, rows * bands)[n > 0], rows).ravel()
            ends = np.concatenate(([0], np.cumsum((n > 0) * bands))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n), pa.array(keys, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["_id", "n_shingles", "set_key", "bands"])
    return run


def id_filter(ids: DataFrame, col: str, bits: int = FILTER_BITS) -> np.ndarray:
    """Bitmap of hashed ids, of fixed size (``bits`` / 8 bytes) whatever the number of ids.

    It only prunes the rows a later exact join would drop: when it fills up, it
    prunes less.
    """
    at = F.pmod(F.xxhash64(F.col(col)), F.lit(bits))
    words = ids.select(F.shiftright(at, 6).alias("w"),
                       F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 64).cast("int")).alias("b"))
    got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return out


def _sets(k: int, rows: int, bands: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = wanted.value
        for b in batches:
            at = b.column(2).to_numpy()
            b = b.filter(pa.array((bitmap[at >> 6] >> (at & 63)) & 1 == 1))
            sets = shingle_sets(_texts(b.column(1)), k)
            marks = (sketches(sets, rows * bands) & np.uint64(0xFF)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_keys(sets), pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary()),
                 pa.array([m.tobytes() for m in marks], pa.binary())], ["rep", "elements", "mark"])
    return run


def alike(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of distinct values have the similarity."""
    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
        return False
    u = np.concatenate((p, q))
    u.sort()
    common = int((u[1:] == u[:-1]).sum())
    return 100 * common >= percent * (len(u) - common)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity.

    The narrow pairs meet the sets of ``b`` first (a group's hub; AQE splits a
    hot one), the wide rows are then dealt out by ``a``.
    """
    both = (pairs.join(sets.select(F.col("rep").alias("b"), F.col("elements").alias("eb")), "b")
                 .join(sets.select(F.col("rep").alias("a"), F.col("elements").alias("ea")), "a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = [alike(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent)
                  for p, q in zip(x.column(2).to_pylist(), x.column(3).to_pylist())]
            keep = x.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([keep.column(0), keep.column(1)], ["a", "b"])
    kind = dict(pairs.dtypes)["a"]
    return both.select("a", "b", "ea", "eb").mapInArrow(run, f"a {kind}, b {kind}")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable over the edges (a, b) (any type that has an order).

    Every round takes the least label among neighbours and then follows labels
    of labels, so paths shorten by more than half a round.  Each round is
    written to the shared folder; nothing but a count comes to the driver.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    label = staged(both.groupBy("a").agg(F.min("b").alias("m"))
                       .select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = (both.join(label.select(F.col("node").alias("b"), "root"), "b")
                    .groupBy("a").agg(F.min("root").alias("m")))
        step = (label.join(near, label["node"] == near["a"])
                     .select("node", F.least("root", "m").alias("root"), F.col("root").alias("old")))
        up = label.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = staged(step.join(up, "root", "left")
                         .select("node", F.least("root", F.coalesce("above", "root")).alias("root"), "old"), "labels")
        moved = new.where(F.col("root") != F.col("old")).limit(1).count()
        label = new.select("node", "root")
        if not moved:
            return label


def merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after the components joined by ``links`` (a, b) are contracted."""
    if roots is None:
        return components(links)
    for c in ("a", "b"):
        at = roots.select(F.col("node").alias(c), F.col("root").alias("_r"))
        links = links.join(at, c, "left").withColumn(c, F.coalesce("_r", c)).drop("_r")
    new = components(links.where("a <> b"))
    nodes = roots.union(new.select("node", F.col("node").alias("root"))).distinct()
    over = new.select(F.col("node").alias("root"), F.col("root").alias("_r"))
    return staged(nodes.join(over, "root", "left").select("node", F.coalesce("_r", "root").alias("root")), "roots")


def _rooted(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return members.withColumn("root", F.col("rep"))
    at = roots.select(F.col("node").alias("rep"), "root")
    return members.join(at, "rep", "left").withColumn("root", F.coalesce("root", "rep"))


def mixed(members: DataFrame, roots: DataFrame | None, turn: int) -> DataFrame:
    """Rows (key, rep, n, root, nb, hub, hub_root) of the buckets that hold more than one component.

    ``nb`` is the number of blocks of the bucket.
    """
    rows = staged(_rooted(members.select("key", "rep", "n"), roots), "members")
    weight = F.ceil(F.sum(F.greatest("n", F.lit(LEAST_SIZE))) / BLOCK).cast("int")
    order = F.struct(F.xxhash64("rep", F.lit(turn)) if turn else F.lit(0).cast("bigint"), F.col("rep"), F.col("root"))
    keys = staged(rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), weight.alias("nb"),
                                          F.min(order).alias("h")).where("lo < hi")
                      .select("key", "nb", F.col("h.rep").alias("hub"), F.col("h.root").alias("hub_root")), "mixed")
    return staged(rows.join(keys, "key"), "mixed-members")


def _exact_blocks(percent: int, coords: int):
    """Links inside blocks: rows (key, i, j, block, id, root, keys, mark, elements) sorted by (key, i, j)."""
    floor = percent / 100
    cut = floor - 5 * math.sqrt(floor * (1 - floor) / coords)

    def links_of(key, cross, block, ids, roots, keys, marks, sets):
        n = np.array([len(x) for x in sets])
        _, comp = np.unique(roots, return_inverse=True)
        for x in range(len(ids) - 1):
            ok = comp[x + 1:] != comp[x]
            if cross:
                ok &= block[x + 1:] != block[x]
            ok &= 100 * np.minimum(n[x + 1:], n[x]) >= percent * np.maximum(n[x + 1:], n[x])
            at = np.flatnonzero(ok) + x + 1
            if len(at):
                at = at[(marks[at] == marks[x]).mean(axis=1) >= cut]
            for y in at:
                if comp[x] != comp[y] and min(keys[x] & keys[y]) == key and alike(sets[x], sets[y], percent):
                    comp[comp == comp[y]] = comp[x]
                    yield max(ids[x], ids[y]), min(ids[x], ids[y])

    def runs(batches):
        held = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            key = np.stack([held.column(c).to_numpy() for c in range(3)])
            edges = [0, *(np.flatnonzero(np.any(key[:, 1:] != key[:, :-1], axis=0)) + 1)]
            for s, e in zip(edges, edges[1:]):
                yield held.slice(s, e - s)
            held = held.slice(edges[-1])
        if held is not None and held.num_rows:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in runs(batches):
            if g.num_rows < 2:
                continue
            marks = np.frombuffer(b"".join(g.column(7).to_pylist()), np.uint8).reshape(g.num_rows, -1)
            found = list(links_of(g.column(0)[0].as_py(), g.column(1)[0].as_py() != g.column(2)[0].as_py(),
                                  *(g.column(c).to_numpy() for c in (3, 4, 5)), [set(x) for x in g.column(6).to_pylist()], marks,
                                  [np.frombuffer(x, np.uint64) for x in g.column(8).to_pylist()]))
            if found:
                kind = g.schema.field(4).type
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i in (0, 1)], ["a", "b"])
    return run


def block_links(rest: DataFrame, sets: DataFrame, percent: int, coords: int) -> DataFrame:
    """Confirmed links (a, b) between the components of the buckets in ``rest`` (see :func:`mixed`)."""
    own = rest.groupBy("rep").agg(F.collect_list("key").alias("keys"))  # at most ``bands`` keys
    full = sets.select("rep", "mark", "elements").join(own, "rep")
    rows = rest.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "root")
    rows = rows.join(full, "rep").select("key", "i", "j", "block", "rep", "root", "keys", "mark", "elements")
    kind = dict(rest.dtypes)["rep"]
    return (rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
                .mapInArrow(_exact_blocks(percent, coords), f"a {kind}, b {kind}"))


def least_ids(sets: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(rep, component_id): the least id of the rows of all sets in the component of each set (rep, least)."""
    if roots is None:
        return sets.withColumnRenamed("least", "component_id")
    linked = staged(sets.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left"), "rooted")
    own = linked.where("root is not null").withColumn("_salt", salt("rep", SALTS))
    heads = own.groupBy("root").agg(F.min("least").alias("component_id"))
    cols = ("rep", "component_id")
    return (salted_lookup(own, heads, "root", "_salt").select(*cols)
            .union(linked.where("root is null").select("rep", F.col("least").alias("component_id"))))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS,
           percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (least id of its group), kept."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    src = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    marks = staged(src.mapInArrow(_sketches(k, rows, bands),
                                  f"_id {kind}, n_shingles bigint, set_key binary, bands array<bigint>"), "sketches")
    # From here on a set is named by its digest (``rep``), never by an id: several texts may share one id.
    reps = staged(marks.where("_id is not null and set_key is not null").groupBy(F.col("set_key").alias("rep"))
                       .agg(F.min("_id").alias("least"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands")), "sets")
    buckets = reps.select("rep", "least", "n", F.explode("bands").alias("key"))
    shared = staged(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "shared")
    members = staged(buckets.join(shared, "key"), "buckets")

    wanted = spark.sparkContext.broadcast(id_filter(members.select("least").distinct(), "least"))
    at = F.pmod(F.xxhash64("_id"), F.lit(FILTER_BITS)).alias("_at")
    sets = staged(src.where("_id is not null").select("_id", "_text", at)
                     .mapInArrow(_sets(k, rows, bands, wanted), "rep binary, elements binary, mark binary")
                     .join(members.select("rep").distinct(), "rep", "left_semi")
                     .dropDuplicates(["rep"]), "elements")

    roots, tried = None, []
    for turn in range(MOST_ROUNDS):
        rest = mixed(members, roots, turn)
        star = (rest.where("root <> hub_root").groupBy("rep", "hub").agg(F.count(F.lit(1)).alias("c"))
                    .select(F.greatest("rep", "hub").alias("a"), F.least("rep", "hub").alias("b"), "rep", "c"))
        for t in tried:
            star = star.join(t, ["a", "b"], "left_anti")
        best = staged(star.groupBy("rep").agg(F.min(F.struct((-F.col("c")).alias("c"), "a", "b")).alias("x"))
                          .select("x.a", "x.b").distinct(), "stars")
        links = staged(confirm(best, sets, percent), "links")
        pairs, joined = best.count(), links.count()
        tried.append(best)
        if joined:
            roots = merged(roots, links)
        if joined < LEAST_SHARE * pairs or not pairs:
            break
    rest = mixed(members, roots, 0)
    links = staged(block_links(rest, sets, percent, rows * bands), "links")
    if links.limit(1).count():
        roots = merged(roots, links)
    final = least_ids(reps.select("rep", "least"), roots).select(F.col("rep").alias("set_key"), "component_id")
    own = marks.select("_id", "n_shingles", "set_key")
    linked = salted_lookup(own.where("_id is not null and set_key is not null").withColumn("_salt", salt("_id", SALTS)),
                           final, "set_key", "_salt")
    alone = own.where("_id is null or set_key is null").withColumn("component_id", F.col("_id"))
    cols = [F.col("_id").alias(id_col), "n_shingles", "component_id",
            F.col("_id").eqNullSafe(F.col("component_id")).alias("kept")]
    return linked.select(*cols).union(alone.select(*cols))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that stay: the least id of every group (rows sharing an id share its fate)."""
    gone = groups(docs, id_col, text_col, **options).where("not kept").select(F.col(id_col).alias("_gone")).distinct()
    return docs.join(gone, docs[f"`{id_col}`"] == gone["_gone"], "left_anti")
