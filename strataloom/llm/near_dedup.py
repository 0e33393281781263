"""Operator 4, near-duplicate classes: ProbMinHash signatures, banding, and an exact check of the candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.common import Scratch, map_arrow, maybe_in, spread_join, table, written
from strataloom.llm.components import components
from strataloom.llm.shingles import jaccard, mix, shingles

#: Least Jaccard similarity of the five-word shingle sets of a link.
SIMILARITY = 0.8
#: Bands and registers of a band. At similarity 0.8 a pair shares none of 36 bands with probability
#: (1 - 0.8 ** 6) ** 36 < 2e-5, however often its shingles repeat: they all weigh the same.
BANDS, ROWS = 40, 6
REGISTERS = BANDS * ROWS
#: Large buckets that a node may lie in without being searched in them: its other 36 bands find its links. The default of
#: the parameter `spare`; with 0 every large bucket is searched by each of its members.
SPARE = 4
#: Estimated similarity below which a candidate isn't read again. With two bits kept of each register, the estimate
#: of a link falls below it with probability below 2e-6.
ESTIMATE = 0.64
#: Members of a bucket up to which its nodes are compared directly; in larger ones rare shingles choose the pairs. Both ways
#: find the same links. The default of the parameter `direct`.
DIRECT = 64
#: Members of one shingle of a large bucket that meet in one task; more are dealt in blocks that meet block by block.
MEET = 1024
#: Members that hold a shingle up to which it counts as rare.
OFTEN = 16
_WORDS = -(-REGISTERS // 32)
_MISSES = int((1 - (ESTIMATE * 0.75 + 0.25)) * REGISTERS)

_U = np.uint64


def signatures(ids: np.ndarray, weights: np.ndarray, at: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """ProbMinHash: (texts, m) hashes of the elements that arrive first in each register; 0 for texts without elements.

    An element of weight w arrives at the times of a Poisson process with rate w, each time in a random register; a
    register keeps the first arrival. Two texts agree in a register with the probability Jaccard similarity of
    their weights. An element stops at its first arrival beyond a bound by which all registers of its text are
    full; the few texts with a register still empty go on with twice the bound. Eleven bits choose the register, so
    there are 2048 at most.
    """
    if m > 2048:
        raise ValueError("more than 2048 registers")
    n = np.diff(at)
    texts = len(n)
    out = np.zeros((texts, m), _U)
    total = np.add.reduceat(np.append(weights, 0.0), at[:-1]) if texts else np.empty(0)
    todo = np.flatnonzero(n > 0)
    bound = np.zeros(texts)
    bound[todo] = m * (np.log(m) + 3) / total[todo]
    owner = np.repeat(np.arange(texts), n)
    while len(todo):
        now = np.zeros(texts, bool)
        now[todo] = True
        live = np.flatnonzero(now[owner])
        x, w, d = ids[live], weights[live], owner[live]
        time, k = np.zeros(len(live)), 0
        slots, times, names = [], [], []
        while len(x):
            k += 1
            r = mix(x + _U(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            time = time - np.log(((r >> _U(11)).astype(np.float64) + 0.5) / (1 << 53)) / w
            early = time < bound[d]
            x, w, d, time, r = x[early], w[early], d[early], time[early], r[early]
            slots.append(d * m + ((r & _U(0x7FF)) * _U(m) >> _U(11)).astype(np.int64))
            times.append(time)
            names.append(x)
        slots, times, names = np.concatenate(slots), np.concatenate(times), np.concatenate(names)
        first = np.full(texts * m, np.inf)
        np.minimum.at(first, slots, times)
        won = times == first[slots]
        out.reshape(-1)[slots[won]] = names[won]
        empty = np.isinf(first.reshape(texts, m)).any(axis=1)
        todo = todo[empty[todo]]
        bound[todo] *= 2
    return out


def _sketch(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Digests of the word sequences, shingle counts, band keys and two bits of each register, 32 registers a word."""
    raw = [t.encode().lower() for t in texts]
    digest = [xxhash.xxh3_128_digest(b" ".join(t.split())) for t in raw]
    ids, _, at = shingles(raw)
    # equal weights make the probability Jaccard that of the sets, which decides a link
    sig = signatures(ids, np.ones(len(ids)), at)
    key = np.zeros((len(raw), BANDS), _U)
    for r in range(ROWS):
        key = mix(key + sig[:, r::ROWS] + _U(r))
    key = mix(key + np.arange(BANDS, dtype=_U))
    two = np.zeros((len(raw), _WORDS * 32), _U)
    two[:, :REGISTERS] = mix(sig) >> _U(62)
    words = np.bitwise_or.reduce(two.reshape(-1, _WORDS, 32) << (np.arange(32, dtype=_U) * _U(2)), axis=2)
    return digest, np.diff(at), key.view(np.int64), words.view(np.int64)


def _sketches(docs: DataFrame, id_col: str, text_col: str, row: Column) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digest, n, key, sig = _sketch(b.column(1).to_pylist())
            keys = [k if c else [] for k, c in zip(key, n, strict=True)]
            cols = [b.column(0), b.column(2), b.column(3), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(list(sig), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "key", "row", "digest", "n", "bands", "sig"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), row_key(id_col, text_col).alias("key"), row.alias("row"))
    return map_arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, key struct<id:bigint,text:bigint>, row {rows.schema['row'].dataType.simpleString()}, digest binary, n bigint, bands array<bigint>, sig array<bigint>")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What finds a text of the input again; rows with equal keys have equal ids and texts."""
    return F.struct(F.xxhash64(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))


def _maybe(left: str, right: str) -> Column:
    """Whether the sizes n and signatures of two nodes leave room for the similarity; suffixes name the sides."""
    n, m = F.col(f"n{left}"), F.col(f"n{right}")
    misses = F.lit(0)
    for i in range(_WORDS):
        x = F.col(f"sig{left}")[i].bitwiseXOR(F.col(f"sig{right}")[i])
        misses = misses + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return (F.least(n, m) >= SIMILARITY * F.greatest(n, m)) & (misses <= _MISSES)


def _beside(pairs: DataFrame, nodes: DataFrame, side: str, scratch: Scratch) -> DataFrame:
    """pairs with size and signature of the node on one side, which may stand in many pairs."""
    met = pairs.groupBy(F.col(side).alias("node")).agg(F.count("*").alias("pairs")).join(nodes.select("node", "n", "sig"), "node")
    known = scratch.write(met.withColumnsRenamed({"node": side, "n": f"n{side}", "sig": f"sig{side}"}), "beside")
    return spread_join(pairs, known, [side], "pairs", "ab".replace(side, "")).drop("pairs")


def _alike(pairs: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of nodes whose sizes and signatures don't rule out the similarity."""
    both = _beside(_beside(pairs, nodes, "a", scratch), nodes, "b", scratch)
    return scratch.write(both.filter(_maybe("a", "b")).select("a", "b"), "alike")


def _texts(docs: DataFrame, wanted: DataFrame, nodes: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(node, text) of the wanted nodes, read from the documents again by row key; few other texts are shuffled."""
    wanted = scratch.write(wanted.join(nodes.select("node", "key"), "node").select("node", "key.id", F.col("key.text").alias("hash")), "wanted")
    rows = docs.select(row_key(id_col, text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("key.id", F.col("key.text").alias("hash"), "text")
    # repeated rows of one key have one text
    found = maybe_in(rows, wanted.select("hash"), "hash").groupBy("id", "hash").agg(F.any_value("text").alias("text"))
    return scratch.write(wanted.join(found, ["id", "hash"]).select("node", "text"), "texts")


def _with_text(rows: DataFrame, texts: DataFrame, side: str, by: str, name: str, scratch: Scratch) -> DataFrame:
    """rows with the text of the node in column `side`, which may stand in many rows."""
    met = rows.groupBy(side).agg(F.count("*").alias("rows")).join(texts.select(F.col("node").alias(side), F.col("text").alias(name)), side)
    return spread_join(rows, scratch.write(met, "used"), [side], "rows", by).drop("rows")


def _linked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """Pairs whose texts are similar, by their whole shingle sets."""
    texts = _texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, id_col, text_col, scratch)
    both = _with_text(_with_text(pairs, texts, "b", "a", "right", scratch), texts, "a", "b", "left", scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([t.encode().lower() for t in b.column(i).to_pylist()] for i in (2, 3))
            yield b.select([0, 1]).filter(pa.array(jaccard(x, y) >= SIMILARITY))

    return scratch.write(map_arrow(both.select("a", "b", "left", "right"), run, "a bigint, b bigint", 128), "links")


def _first(n: int) -> int:
    """Elements, in any one order, of which a set of n shares one with each set that is similar and not larger."""
    return n - (4 * n + 4) // 5 + 1


def _rare_pairs(members: DataFrame, texts: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of nodes in different classes that share a head and may be similar, by their signatures too.

    members: head, node, class. Two sets of n and m elements with similarity 0.8 share c = 4/9 (n + m) elements or
    more. In any one order of all shingles they then share one of the first n - c + 1 of the one that is also among
    the first m - c + 1 of the other. A head's order has the shingles first that it lacks and few members hold,
    then those that it lacks and many hold (by a bitmap of the head's, so the order is one for all its members), then its
    own: few of the others are met. One minus the similarity is a metric, so nodes whose similarities
    to the head differ by more than 0.2 can't be similar to each other.
    """
    own = members.join(texts.select("node", "text"), "node")
    both = _with_text(own, texts, "head", "node", "top", scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (x, _, at), (h, _, at_h) = (shingles([t.encode().lower() for t in b.column(i).to_pylist()]) for i in (3, 4))
            lack, held, far = [], [], []
            for i in range(b.num_rows):
                own, top = x[at[i] : at[i + 1]], h[at_h[i] : at_h[i + 1]]
                known = np.isin(own, top, assume_unique=True)
                lack.append(own[~known].view(np.int64))
                held.append(own[known][: _first(len(own))].view(np.int64))
                far.append(1 - len(own[known]) / max(len(own) + len(top) - len(own[known]), 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.diff(at), pa.int64()), pa.array(far, pa.float64()), *(pa.array(c, pa.list_(pa.int64())) for c in (lack, held))], ["head", "node", "class", "n", "far", "lack", "held"])

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = []
            for n, lack, held, bits in zip(*(c.to_pylist() for c in b.columns[3:4] + b.columns[5:8]), strict=True):
                lack = np.array(lack, np.int64)
                often = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")[lack & 0x7FFF].astype(bool) if bits else np.zeros(len(lack), bool)
                ids.append(np.concatenate((lack[~often], lack[often], np.array(held, np.int64)))[: _first(n)])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(ids, pa.list_(pa.int64()))], ["head", "node", "class", "n", "far", "ids"])

    cols = "head bigint, node bigint, class bigint, n bigint, far double"
    rows = scratch.write(map_arrow(both.select("head", "node", "class", "text", "top"), run, f"{cols}, lack array<bigint>, held array<bigint>", 128), "lack")
    often = rows.select("head", F.explode("lack").alias("id")).groupBy("head", "id").agg(F.count("*").alias("c")).filter(F.col("c") > OFTEN)
    maps = often.groupBy("head").agg(F.bitmap_construct_agg(F.pmod("id", F.lit(1 << 15))).alias("bits"))
    maps = scratch.write(rows.groupBy("head").agg(F.count("*").alias("members")).join(maps, "head", "left"), "often")
    rows = spread_join(rows, maps, ["head"], "members", "node").select("head", "node", "class", "n", "far", "lack", "held", "bits")
    rows = scratch.write(map_arrow(rows, ordered, f"{cols}, ids array<bigint>", 128), "first")
    rows = rows.select("head", "node", "class", "n", "far", F.posexplode("ids").alias("place", "id"))
    common = scratch.write(rows.groupBy("head", "id").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("holders")).filter("low <> high").drop("low", "high"), "common")
    first = spread_join(rows, common, ["head", "id"], "holders", "node").withColumn("blocks", F.ceil(F.col("holders") / MEET).cast("int")).drop("holders")
    first = scratch.write(first.join(nodes.select("node", "sig"), "node"), "rare")
    # the block of a member on its own side, and every block of the other side
    own, other = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sides = [first.select(*[F.col(c).alias(f"{c[0]}{x}") for c in ("head", "class", "n", "far", "id", "place")], F.col("sig").alias(f"sig{x}"), F.col("node").alias(x), y.alias(f"x{x}"), z.alias(f"y{x}")) for x, y, z in (("a", own, other), ("b", other, own))]
    shared = "floor((4 * (na + nb) + 8) / 9)"  # places count from 0
    meet = F.expr(f"ha = hb AND ia = ib AND xa = xb AND ya = yb AND a < b AND ca <> cb AND 5 * least(na, nb) >= 4 * greatest(na, nb) AND pa <= na - {shared} AND pb <= nb - {shared} AND abs(fa - fb) <= {1 - SIMILARITY} + 1e-9")
    return scratch.write(sides[0].join(sides[1], meet & _maybe("a", "b")).select("a", "b").distinct(), "rare-pairs")


def _large(large: DataFrame, classes: DataFrame, docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(head, node, class) and texts of the members of large buckets.

    Buckets whose heads are of one class are searched together: of these heads the one with the most members orders
    the shingles, whether or not it is searched itself.
    """
    heads = large.groupBy("head").agg(F.count("*").alias("members")).join(classes.select(F.col("node").alias("head"), F.col("class").alias("group")), "head", "left")
    heads = scratch.write(heads.withColumn("group", F.coalesce("group", "head")), "by-head")
    first = heads.groupBy("group").agg(F.max(F.struct("members", "head"))["head"].alias("top"))
    top = scratch.write(heads.join(first, "group").select("head", "top", "members"), "top")
    many = spread_join(large.drop("members"), top, ["head"], "members", "node")
    many = scratch.write(many.select(F.col("top").alias("head"), "node", "class").distinct(), "many")
    wanted = many.select(F.explode(F.array("node", "head")).alias("node")).distinct()
    return many, _texts(docs, wanted, nodes, id_col, text_col, scratch)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None, spare: int = SPARE, direct: int = DIRECT) -> DataFrame:
    """doc_id, class_id, class_size, kept for each row of docs, and `row` where such a column is given.

    Words are runs without white space, ASCII letters in lower case; a link joins two texts whose five-word shingle
    sets have a Jaccard similarity of 0.8 or more, or whose words are the same; a class is a connected component of
    links. class_id is the smallest id of the class (nulls last), whose first row alone is kept. A text of one to
    four words is one shingle; null, empty and blank texts are copies of each other. Other columns are ignored;
    an empty table gives an empty result; a null id stays null; rows that repeat are copies of each other.

    Copies count once: a node is a distinct word sequence, and only nodes are banded. Every bucket first links its
    members to its head. What that leaves in different components of one bucket is then compared, directly in
    buckets of up to `direct` members, and by a search over rare shingles in larger ones: none is capped. A node in
    `spare` large buckets or fewer isn't searched there, as its other bands meet its links with the probability stated
    at BANDS; with 0 it is searched in all. A signature rules out a link with probability below 2e-6. Links rest on the whole texts; only
    candidates' texts, found by a bitmap filter, are shuffled.
    """
    scratch = Scratch(docs.sparkSession, "near")
    sketches = scratch.write(_sketches(docs, id_col, text_col, F.lit(0) if row is None else row).withColumn("uid", F.monotonically_increasing_id()), "sketches")
    order = F.struct(F.col("id").isNull().alias("z"), "id", "uid")
    copies = scratch.write(sketches.groupBy("digest").agg(F.min("uid").alias("node"), F.min(order).alias("best"), F.count("*").alias("rows")), "copies")
    nodes = scratch.write(sketches.join(copies.select(F.col("node").alias("uid")), "uid").select(F.col("uid").alias("node"), "key", "n", "sig", "bands"), "nodes")

    banded = nodes.select("node", F.explode("bands").alias("band"))
    full = scratch.write(banded.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1"), "full")
    shared = scratch.write(spread_join(banded, full, ["band"], "members", "node"), "shared")
    # the head of a bucket is the node with the largest buckets: of a text and its variants, the text
    weight = shared.groupBy("node").agg(F.sum("members").alias("weight"), F.count_if(F.col("members") > direct).alias("large"))
    weighed = scratch.write(shared.drop("members").join(weight, "node"), "weighed")
    heads = weighed.groupBy("band").agg(F.max(F.struct("weight", (-F.col("node")).alias("node")))["node"].alias("head"), F.count("*").alias("members"))
    heads = scratch.write(heads.withColumn("head", -F.col("head")), "heads")
    buckets = scratch.write(spread_join(weighed.drop("weight"), heads, ["band"], "members", "node"), "buckets")

    star = scratch.write(buckets.filter("head <> node").select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).distinct(), "star")
    links = _linked(_alike(star, nodes, scratch), docs, nodes, id_col, text_col, scratch)
    classes = scratch.write(components(links, scratch), "classes")

    # members of one bucket that are still in different components; sizes within 0.8 fall in neighbouring steps
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / SIMILARITY)))
    placed = buckets.filter((F.col("members") <= direct) | (F.col("large") > spare)).drop("large")
    placed = scratch.write(placed.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node")), "placed")
    open_ = placed.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("searched")).filter("low <> high").drop("low", "high")
    placed = scratch.write(spread_join(placed, scratch.write(open_, "open"), ["band"], "searched", "node"), "searched")
    few = scratch.write(placed.filter(F.col("members") <= direct).join(nodes.select("node", "n", "sig", step.cast("int").alias("step")), "node"), "few")
    side = lambda x, at: few.select("band", F.col("node").alias(x), F.col("class").alias(f"c{x}"), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"sig{x}"), at.alias("step"))
    left, right = side("a", F.explode(F.array("step", F.col("step") + 1))), side("b", F.col("step"))
    r = right.withColumnsRenamed({"band": "rband", "step": "rstep"})
    near = left.join(r, (F.col("band") == F.col("rband")) & (F.col("step") == F.col("rstep")) & (F.col("ca") != F.col("cb")) & _maybe("a", "b"))
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    cross = near.distinct()
    large = placed.filter(F.col("members") > direct)
    if not large.isEmpty():
        cross = cross.unionByName(_rare_pairs(*_large(large, classes, docs, nodes, id_col, text_col, scratch), nodes, scratch)).distinct()
    cross = scratch.write(cross.join(star, ["a", "b"], "left_anti"), "cross")
    upper = None
    if not cross.isEmpty():
        joined = _linked(cross, docs, nodes, id_col, text_col, scratch)
        own = classes.select("node", "class")
        lifted = joined.join(own.select(F.col("node").alias("a"), F.col("class").alias("x")), "a", "left").join(own.select(F.col("node").alias("b"), F.col("class").alias("y")), "b", "left")
        lifted = scratch.write(lifted.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).filter("a <> b"), "lifted")
        upper = None if lifted.isEmpty() else components(lifted, scratch).select(F.col("node").alias("class"), F.col("class").alias("top"))

    # classes of the distinct texts first, then of the rows: neither a class nor a group of copies meets in one task
    texts = copies.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    if upper is not None:
        texts = texts.join(upper, "class", "left").withColumn("class", F.coalesce("top", "class"))
    texts = scratch.write(texts.select("digest", "class", "best", "rows"), "texts")
    sums = scratch.write(texts.groupBy("class").agg(F.min("best").alias("best"), F.sum("rows").alias("class_size"), F.count("*").alias("texts")), "sums")
    found = scratch.write(spread_join(texts.select("digest", "class", "rows"), sums, ["class"], "texts", "digest").drop("class", "texts"), "found")
    rows = spread_join(sketches.select("uid", "id", "row", "digest"), found, ["digest"], "rows", "uid")
    out = rows.select(F.col("id").alias("doc_id"), *([] if row is None else ["row"]), F.col("best.id").alias("class_id"), "class_size", (F.col("best.uid") == F.col("uid")).alias("kept"))
    out, _ = written(out, "near-rows")
    scratch.clear()
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents", deal=True))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT *, row_number() OVER () AS k FROM (SELECT array_to_string(w, ' ') AS s, any_value(w) AS w FROM d GROUP BY 1)),
g AS MATERIALIZED (SELECT DISTINCT k, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT k, count(*) AS n FROM g GROUP BY k),
p AS (SELECT x.k AS a, y.k AS b, count(*) AS both_ FROM g x JOIN g y ON x.g = y.g AND x.k <> y.k GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE both_ >= 0.8::double * (x.n + y.n - both_)),
r(k, other) AS (SELECT k, k FROM t UNION SELECT r.k, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT k, min(other) AS class FROM r GROUP BY k),
o AS (SELECT d.doc_id, c.class FROM d JOIN t ON t.s = array_to_string(d.w, ' ') JOIN c ON c.k = t.k)
SELECT doc_id, min(doc_id) OVER (PARTITION BY class) AS class_id, count(*) OVER (PARTITION BY class) AS class_size, row_number() OVER (PARTITION BY class ORDER BY doc_id NULLS LAST) = 1 AS kept FROM o"""
