"""Merkle manifest of a data set as a tree of SHA-256 midstates.

H is the lowercase hex SHA-256 of its inputs put together. A row's leaf is H of its columns, each ``-`` if null, else its
UTF-8 byte count, ``:`` and the value. The leaves of a source ascend by doc_id; while there are several nodes, every
``FAN`` consecutive ones become their H. What remains is the source's subroot; the subroots, in the order of their sources, give the root in the same way.

A child's digest as hex text is one block of SHA-256, so a parent keeps the hash state before each of its child slots, 32
bytes each (``sha_state.py``). To fold a changed leaf up to the root, each level resumes the state at its slot with the new
digest and the siblings right of it only; what is left of it is in the state. Left siblings serve the proofs alone.

Places in a source come from ranges of the whole order and their sizes, so a source of any size is many tasks. A level is
one shuffle of 32-byte digests, a sixteenth of the rows of the one below, in groups of ``FAN`` at most. Paths go down the
same way: a run of leaves gets the steps above it once, about 230 bytes a leaf in all.

Defined cases: nulls in any column are hashed as ``-``; a null doc_id sorts first; rows of one doc_id are in the order of
their leaves; equal rows are leaves each; the null source is a tree of its own and comes first; extra columns are not
hashed; an empty table has no root and gives an empty result. Building runs jobs; the tables of a manifest stay in the
shared folder until ``drop_manifest``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, numbered, sized, table, written
from .sha_state import START, bytes_to_words, compress, hex_blocks, hex_text, last_blocks, words_to_bytes

FAN = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree of all sources' subroots.
TOP = "top"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Manifest:
    """runs: (tree, level, idx, kids, states): of each parent its children's digests and the states before their slots;
    its children are at ``level``, it is number ``idx`` of its tree at the level above. leaves: (tree, idx, payload…) by
    level 0. subroots: (tree, levels, digest); ``levels``: how many the tree has above its leaves."""

    leaves: DataFrame
    runs: DataFrame
    subroots: DataFrame
    depth: int
    top: Manifest | None = None


def leaf_digest(columns: dict[str, Column]) -> Column:
    """The digest (binary) of a row with these ``columns``."""
    def part(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(part, columns.values())).cast("binary"), 256))


def _matrix(digests: pa.Array) -> np.ndarray:
    """(n, 32) bytes of binary values of 32 bytes."""
    return np.frombuffer(b"".join(digests.to_pylist()), np.uint8).reshape(-1, 32)


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kids to (states, digest)."""
    for batch in batches:
        kids = batch.column(batch.schema.get_field_index("kids"))
        size = np.diff(kids.offsets.to_numpy())
        first = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        block = hex_blocks(_matrix(kids.flatten()))
        state = np.repeat(START[:, None], len(size), axis=1)
        before = np.zeros((FAN, len(size), 32), np.uint8)
        for slot in range(int(size.max(initial=0))):
            on = np.flatnonzero(size > slot)
            before[slot] = words_to_bytes(state)
            state[:, on] = compress(state[:, on], block[:, first[on] + slot])
        digest = words_to_bytes(compress(state, last_blocks(size)))
        states = [[before[slot, k].tobytes() for slot in range(n)] for k, n in enumerate(size)]
        columns = [*batch.columns, pa.array(states, pa.list_(pa.binary())), pa.array([x.tobytes() for x in digest], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "states", "digest"])


def build(nodes: DataFrame, payload: list[str] = ()) -> Manifest:
    """The trees over ``nodes`` (tree, idx, n, digest, payload…): place in the tree from 0, size of the tree. A written table."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, roots, level = [], [nodes.filter("n = 1").select("tree", F.lit(0).alias("levels"), "digest")], 0
    now = nodes.select("tree", "idx", "n", "digest")
    while most > 1:
        runs = now.filter("n > 1").groupBy("tree", F.shiftright("idx", 4).alias("idx"), "n").agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("kids"))
        runs = runs.select("tree", F.lit(level).alias("level"), "idx", F.shiftright(F.col("n") + (FAN - 1), 4).alias("n"), F.col("kids.digest").alias("kids"))
        runs = written(runs.mapInArrow(_hash_runs, "tree string, level int, idx long, n long, kids array<binary>, states array<binary>, digest binary"), "level")
        level, most = level + 1, -(-most // FAN)
        roots.append(runs.filter("n = 1").select("tree", F.lit(level).alias("levels"), "digest"))
        levels.append(runs)
        now = runs.select("tree", "idx", "n", "digest")
    empty = nodes.sparkSession.createDataFrame([], "tree string, level int, idx long, n long, kids array<binary>, states array<binary>, digest binary")
    leaves = nodes.select("tree", "idx", "n", "digest", *payload)
    return Manifest(leaves, reduce(DataFrame.union, levels, empty), reduce(DataFrame.union, roots), level)


def _of_level(runs: DataFrame, level: int) -> DataFrame:
    return runs.filter(F.col("level") == level)


STEP = "array<struct<state:binary,left:array<binary>,right:array<binary>>>"


def _down(m: Manifest, above: DataFrame, least: int) -> DataFrame:
    """Paths of the nodes of level ``least``: (tree, idx, subroot, root, steps), one job whose joins shrink with the level.

    ``above``: (tree, root, steps), the steps over each tree's subroot."""
    tops = m.subroots.join(above, "tree")
    start = lambda level: tops.filter(F.col("levels") == level).select("tree", F.lit(0).cast("long").alias("idx"), F.col("digest").alias("subroot"), "root", "steps")
    paths = start(m.depth)
    for level in range(m.depth - 1, least - 1, -1):
        at = _of_level(m.runs, level).select("tree", "idx", "kids", "states").join(paths, ["tree", "idx"])
        at = at.select("tree", "idx", "kids", "states", "subroot", "root", "steps", F.posexplode("kids").alias("slot", "own"))
        step = F.struct(F.get("states", F.col("slot")).alias("state"), F.slice("kids", F.lit(1), F.col("slot")).alias("left"), F.slice("kids", F.col("slot") + 2, F.lit(FAN)).alias("right"))
        kids = at.select("tree", (F.col("idx") * FAN + F.col("slot")).alias("idx"), "subroot", "root", F.concat(F.array(step), "steps").alias("steps"))
        paths = kids.union(start(level))
    return paths


def build_forest(leaves: DataFrame, order: list[str], payload: list[str] = ()) -> Manifest:
    """A tree for each source of ``leaves`` (source, digest, the columns of ``order`` and payload) and one over their subroots."""
    tree = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))  # "null" sorts before "s…", and no source has that name
    at = numbered(leaves.withColumn("tree", tree).drop("source"), ["tree", *order], "at")
    trees = written(at.groupBy("tree").agg(F.min("at").alias("first"), F.count("*").alias("n")), "trees")
    nodes = at.join(sized(trees, trees.count()), "tree").select("tree", (F.col("at") - F.col("first")).alias("idx"), "n", "digest", *payload)
    found = build(written(nodes, "leaves"), payload)
    drop(at)
    found.subroots = written(found.subroots, "subroots")
    subroots = numbered(found.subroots.select("tree", "digest"), ["tree"], "idx")
    n = trees.count()
    drop(trees)
    found.top = build(written(subroots.select(F.lit(TOP).alias("tree"), "idx", F.lit(n).cast("long").alias("n"), "digest", F.col("tree").alias("source_tree")), "sources"), ["source_tree"])
    drop(subroots)
    return found


def paths(m: Manifest) -> DataFrame:
    """(tree, idx, subroot, root, steps) of each node of level 1, and of each lone leaf as level 0 (column ``level``). Written."""
    none = F.expr(f"cast(array() as {STEP})").alias("steps")
    own = _down(m.top, m.top.subroots.select("tree", F.col("digest").alias("root"), none), 0)
    above = m.top.leaves.select(F.col("source_tree").alias("tree"), "idx").join(own.select("idx", "root", "steps"), "idx")
    above = written(above.select("tree", "root", "steps"), "above")
    lone = m.subroots.filter("levels = 0").join(above, "tree").select("tree", F.lit(0).cast("long").alias("idx"), F.col("digest").alias("subroot"), "root", "steps")
    lone = lone.withColumn("level", F.lit(0))
    out = written(_down(m, above, 1).withColumn("level", F.lit(1)).unionByName(lone) if m.depth else lone, "leaf-paths")
    drop(above)
    return out


def drop_manifest(m: Manifest | None) -> None:
    if m:
        for t in (m.leaves, m.runs, m.subroots):
            drop(t)
        drop_manifest(m.top)


def _resume(state: np.ndarray, new: np.ndarray, right: np.ndarray, n_right: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests (n, 32) of parents of ``blocks`` children: from the state before a slot on, its new digest, then the siblings
    to its right, (n, FAN - 1, 32), of which ``n_right`` count."""
    state = compress(state, hex_blocks(new))
    for k in range(int(n_right.max(initial=0))):
        on = np.flatnonzero(n_right > k)
        state[:, on] = compress(state[:, on], hex_blocks(right[on, k]))
    return words_to_bytes(compress(state, last_blocks(blocks)))


def _padded(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """((n, FAN - 1, 32) digests, their number) of lists of digests."""
    raw = b"".join(b"".join(x).ljust(32 * (FAN - 1), b"\0") for x in lists)
    return np.frombuffer(raw, np.uint8).reshape(-1, FAN - 1, 32), np.array([len(x) for x in lists], np.int64)


PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a run of leaves (level, subroot, root, steps, kids, states, ids, changed) to a row for each leaf."""
    for whole in batches:
        for from_row in range(0, whole.num_rows, 512):
            runs = whole.slice(from_row, 512).to_pylist()
            ids, run_of, new, leaves, proofs, own = [], [], [], [], [], []
            for k, run in enumerate(runs):
                upper = b"".join(d for s in run["steps"] for side in (s["left"], s["right"]) for d in side).hex().encode()
                for slot, (doc_id, leaf, changed) in enumerate(zip(run["ids"], run["kids"], run["changed"])):
                    left, right = (run["kids"][:slot], run["kids"][slot + 1 :]) if run["level"] else ([], [])
                    proofs.append(hashlib.sha256(b"".join(left + right).hex().encode() + upper).hexdigest())
                    ids.append(doc_id)
                    run_of.append(k)
                    leaves.append(leaf)
                    new.append(changed or leaf)
                    own.append((run["states"][slot], right, len(left) + 1 + len(right)) if run["level"] else (bytes(32), [], 0))
            folded = np.frombuffer(b"".join(new), np.uint8).reshape(-1, 32).copy()
            at = np.flatnonzero([x[2] for x in own])
            if len(at):
                right, n_right = _padded([own[i][1] for i in at])
                state = bytes_to_words(np.frombuffer(b"".join(own[i][0] for i in at), np.uint8).reshape(-1, 32))
                folded[at] = _resume(state, folded[at], right, n_right, np.array([own[i][2] for i in at]))
            # leaves of a run whose parents have the same digest go up together
            key = np.concatenate([np.array(run_of, ">u4").view(np.uint8).reshape(-1, 4), folded], axis=1)
            key, back = np.unique(key, axis=0, return_inverse=True)
            up, run_up = key[:, 4:].copy(), np.ascontiguousarray(key[:, :4]).view(">u4").ravel().astype(np.int64)
            for level in range(max(len(r["steps"]) for r in runs)):
                at = np.flatnonzero([len(runs[k]["steps"]) > level for k in run_up])
                steps = [runs[k]["steps"][level] for k in run_up[at]]
                right, n_right = _padded([s["right"] for s in steps])
                state = bytes_to_words(np.frombuffer(b"".join(s["state"] for s in steps), np.uint8).reshape(-1, 32))
                up[at] = _resume(state, up[at], right, n_right, n_right + 1 + np.array([len(s["left"]) for s in steps]))
            text = hex_text(up)[back.ravel()]
            columns = [pa.array(ids, pa.int64()), *(pa.array([x.hex() for x in xs], pa.string()) for xs in (leaves, [runs[k]["subroot"] for k in run_of], [runs[k]["root"] for k in run_of])), pa.array(proofs, pa.string()), pa.array([x.tobytes().decode() for x in text], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"])


def prove(m: Manifest) -> DataFrame:
    """Per leaf of a forest with payload (doc_id, changed): its digests, the hash of its proof, and the root that its changed
    digest, or its own where that is null, folds to. A written table."""
    leaf = F.struct("idx", "doc_id", "changed", "digest")
    up = paths(m)
    several = m.leaves.filter("n > 1").groupBy("tree", F.shiftright("idx", 4).alias("idx")).agg(F.array_sort(F.collect_list(leaf)).alias("x"))
    runs = several.join(_of_level(m.runs, 0).select("tree", "idx", "states"), ["tree", "idx"]) if m.depth else several.withColumn("states", F.expr("cast(array() as array<binary>)"))
    lone = m.leaves.filter("n = 1").select("tree", "idx", F.array(leaf).alias("x"), F.expr("cast(array() as array<binary>)").alias("states"))
    both = runs.withColumn("level", F.lit(1)).unionByName(lone.withColumn("level", F.lit(0))).join(up, ["tree", "idx", "level"])
    rows = both.select("level", "subroot", "root", "steps", F.col("x.digest").alias("kids"), "states", F.col("x.doc_id").alias("ids"), F.col("x.changed").alias("changed"))
    out = written(rows.mapInArrow(_prove, PROVED), "proved")
    drop(up)
    return out


def manifest(docs: DataFrame, changed: Column | None = None) -> Manifest:
    """The forest over ``docs`` (``COLUMNS``), with payload (doc_id, changed): ``changed`` is the digest of a row's other version."""
    own = leaf_digest({c: F.col(c) for c in COLUMNS}).alias("digest")
    other = (F.lit(None).cast("binary") if changed is None else changed).alias("changed")
    leaves = written(docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), own, other), "digests")
    # "key" tells equal rows apart, so that any number of them is cut into ranges
    found = build_forest(leaves.withColumn("key", F.monotonically_increasing_id()), ["doc_id", "digest", "key"], ["doc_id", "changed"])
    drop(leaves)
    return found


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = leaf_digest({c: F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in COLUMNS})
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    m = manifest(docs, F.when(chosen, tampered))
    rows = prove(m)
    drop_manifest(m)
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql_tree(name: str, nodes: str) -> str:
    """Recursive levels of the trees over ``nodes`` (tree, idx, n, digest), in table ``name`` with level lv."""
    return f"""{name} AS (
  SELECT tree, 0 AS lv, idx, n, digest FROM {nodes}
  UNION ALL
  SELECT tree, lv + 1, idx // {FAN}, (n + {FAN - 1}) // {FAN}, sha256(string_agg(digest, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY tree, lv, idx // {FAN}, n)"""


_SQL_PART = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_SQL_LEAF = lambda text: "sha256(" + " || ".join(_SQL_PART.format(text if c == "text" else c) for c in COLUMNS) + ")"
_SQL_CRC = "(4294967295 - list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"
OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, doc_id, leaf, coalesce(changed, leaf) AS changed
  FROM (SELECT doc_id, source, {_SQL_LEAF("text")} AS leaf, CASE WHEN {_SQL_CRC} % 5 = 0 THEN {_SQL_LEAF(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed FROM documents)),
base AS (SELECT tree, idx, n, leaf AS digest FROM d),
{_sql_tree("low", "base")},
subroots AS (SELECT 0 AS tree, tree AS idx, count(*) OVER () AS n, digest FROM low WHERE n = 1),
{_sql_tree("high", "subroots")},
path AS (
  SELECT d.doc_id, d.tree, d.idx AS leaf_idx, l.lv, string_agg(l.digest, '' ORDER BY l.idx) FILTER (l.idx < (d.idx >> (4 * l.lv))) AS lefts, string_agg(l.digest, '' ORDER BY l.idx) FILTER (l.idx > (d.idx >> (4 * l.lv))) AS rights
  FROM d JOIN low l ON l.tree = d.tree AND l.n > 1 AND (l.idx >> 4) = d.idx >> (4 * l.lv + 4) GROUP BY ALL
  UNION ALL
  SELECT d.doc_id, d.tree, d.idx, 1000 + h.lv, string_agg(h.digest, '' ORDER BY h.idx) FILTER (h.idx < (d.tree >> (4 * h.lv))), string_agg(h.digest, '' ORDER BY h.idx) FILTER (h.idx > (d.tree >> (4 * h.lv)))
  FROM d JOIN high h ON h.n > 1 AND (h.idx >> 4) = d.tree >> (4 * h.lv + 4) GROUP BY ALL),
steps AS (SELECT doc_id, tree, leaf_idx, list([coalesce(lefts, ''), coalesce(rights, '')] ORDER BY lv) AS steps, sha256(string_agg(coalesce(lefts, '') || coalesce(rights, ''), '' ORDER BY lv)) AS proof FROM path GROUP BY ALL),
folds AS (
  SELECT d.tree, d.idx, 1 AS k, d.changed AS digest, coalesce(s.steps, []) AS steps FROM d LEFT JOIN steps s ON s.tree = d.tree AND s.leaf_idx = d.idx
  UNION ALL SELECT tree, idx, k + 1, sha256(steps[k][1] || digest || steps[k][2]), steps FROM folds WHERE k <= len(steps))
SELECT d.doc_id, d.leaf, r.digest AS subroot, t.digest AS root, coalesce(s.proof, sha256('')) AS proof_sha256, f.digest AS folded_root, f.digest = t.digest AS verified
FROM d LEFT JOIN steps s ON s.tree = d.tree AND s.leaf_idx = d.idx JOIN subroots r ON r.idx = d.tree JOIN high t ON t.n = 1 JOIN folds f ON f.tree = d.tree AND f.idx = d.idx AND f.k = len(f.steps) + 1
"""
