"""Merkle manifest of a dataset: a tree of SHA-256 states, which proves any row and is folded again from a changed one.

H is the lowercase hex SHA-256 of its inputs, concatenated; digests go in as hex text. A leaf is H of doc_id, source, lang, n_chars and text, each ``-``
if null, else its UTF-8 byte count, ``:`` and its value. The leaves of a lang ascend by doc_id (null first; equal ids by leaf, so only equal rows are
interchangeable); every two consecutive nodes become their H, an odd last one its own H, until one is left, the subroot. A lone leaf is its subroot.
Subroots by lang (null first, UTF-8 bytewise) make the root in the same way.

Two children are two blocks of 64 bytes of SHA-256, so a parent can keep a copy of the state of its hash before each child slot: the initial one before
the first, the one after the left child before the second. Folding a replaced leaf resumes, at every level, the state before its slot, puts in the
replacement and its right sibling if there is one, and never hashes what is left of it again.

Leaves are hashed in the JVM, numbered within their lang by a range shuffle of ids and digests only, and dealt into blocks of 2**BLOCK consecutive ones,
each a subtree that one task builds; the blocks' roots are the leaves of the next round, so a lang of any size takes log(n) / BLOCK rounds. On the way down
every block gets the steps above it (kept states and siblings, one row a block), so that the last pass folds all rows of a block to the root.

Very long texts are hashed whole. Repeated rows are leaves of their own. An empty table gives no rows. Rows with a null doc_id or n_chars are not
tampered with. Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.llm import sha256
from panelforge.llm.common import batch_rows, in_fold, settled

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of a block.
BLOCK = 11
TAMPER = 7
#: Bytes of a step: slot (0: left with a right sibling, 1: left alone, 2: right), kept state, sibling.
STEP = 65
_NODE = "lang_key string, pos bigint, n bigint, hash binary"


def leaf(fields: dict[str, Column] | None = None) -> Column:
    """Digest of a row as hex text; fields replaces columns."""
    each = []
    for c in FIELDS:
        text = (fields or {}).get(c, F.col(c)).cast("string")
        each.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*each), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with pos, the place of each in its lang_key by ``order`` (from 0), and n, the number of rows of that; one range shuffle, offsets added afterwards."""
    placed = settled(rows.withColumn("_row", F.monotonically_increasing_id()), "placed")  # the sample of the ranges does not hash the texts again
    dealt = placed.repartitionByRange("lang_key", *order, "_row").sortWithinPartitions("lang_key", *order, "_row").drop("_row")
    dealt = settled(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "dealt")
    parts = dealt.groupBy("lang_key", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_count"))
    before = Window.partitionBy("lang_key").orderBy("_part")
    offsets = parts.select("lang_key", "_part", (F.sum("_count").over(before) - F.col("_count") - F.col("_first")).alias("_add"), F.sum("_count").over(Window.partitionBy("lang_key")).alias("n"))
    return dealt.join(offsets, ["lang_key", "_part"]).withColumn("pos", F.col("_at") + F.col("_add")).drop("_part", "_at", "_add")


class Subtree:
    """All levels of a block of consecutive nodes, with the state of each parent after its left child."""

    def __init__(self, digests: np.ndarray, n: int, most: int):
        self.levels, self.kept = [digests], []
        for _ in range(min(most, (n - 1).bit_length())):
            h = self.levels[-1]
            pairs = h.shape[1] // 2
            mid = sha256.extend(sha256.start(-(-h.shape[1] // 2)), h[:, 0::2])
            up = np.empty_like(mid)
            if pairs:
                up[:, :pairs] = sha256.finish(sha256.extend(mid[:, :pairs], h[:, 1::2]), 2)
            if h.shape[1] % 2:
                up[:, pairs:] = sha256.finish(mid[:, pairs:], 1)
            self.kept.append(mid)
            self.levels.append(up)

    def steps(self):
        """At each level, for every lowest node: slot, state before that slot, sibling."""
        at = np.arange(self.levels[0].shape[1])
        for h, mid in zip(self.levels[:-1], self.kept, strict=True):
            right = at & 1 == 1
            alone = ~right & (at + 1 == h.shape[1])
            state = np.where(right, mid[:, at >> 1], sha256.START[:, None])
            sibling = np.where(alone, np.uint32(0), h[:, np.where(alone, at, at ^ 1)])
            yield np.where(right, 2, alone.astype(np.int64)), state, sibling
            at = at >> 1


def _resumed(own: np.ndarray, slot: np.ndarray, state: np.ndarray, sibling: np.ndarray) -> np.ndarray:
    """Digests of the parents, from the states kept before the slots, the replacements and right siblings."""
    state = sha256.extend(state, own)
    out = np.empty_like(own)
    pair = slot == 0
    if pair.any():
        out[:, pair] = sha256.finish(sha256.extend(state[:, pair], sibling[:, pair]), 2)
    for which, blocks in ((slot == 1, 1), (slot == 2, 2)):
        if which.any():
            out[:, which] = sha256.finish(state[:, which], blocks)
    return out


def _sorted(block: pa.Table) -> pa.Table:
    return block.take(pa.array(np.argsort(block.column("pos").to_numpy(), kind="stable")))


def _subroot(block: pa.Table, most: int) -> pa.Table:
    """The root of one block's subtree, a node of the next round."""
    block = _sorted(block)
    n = block.column("n")[0].as_py()
    tree = Subtree(sha256.from_bytes(block.column("hash").to_pylist()), n, most)
    row = {"lang_key": block.column("lang_key")[:1], "pos": pa.array([block.column("pos")[0].as_py() >> most]), "n": pa.array([-(-n >> most)])}
    return pa.table(row | {"hash": pa.array(sha256.to_bytes(tree.levels[-1]), pa.binary())})


def _paths(block: pa.Table, above: pa.Table, most: int) -> pa.Table:
    """The steps from every node of a block to the root."""
    block = _sorted(block)
    tree = Subtree(sha256.from_bytes(block.column("hash").to_pylist()), block.column("n")[0].as_py(), most)
    path = [b""] * block.num_rows
    for slot, state, sibling in tree.steps():
        for k, (s, a, b) in enumerate(zip(slot.tolist(), sha256.to_bytes(state), sha256.to_bytes(sibling), strict=True)):
            path[k] += bytes([s]) + a + b
    rest = above.column("path")[0].as_py()
    return pa.table({"lang_key": block.column("lang_key"), "pos": block.column("pos"), "path": pa.array([p + rest for p in path], pa.binary())})


def _folded(block: pa.Table, above: pa.Table, most: int) -> pa.Table:
    """Digest of all siblings and folded root of every leaf of a block."""
    block = _sorted(block)
    digests = block.column("hash").to_pylist()
    tree = Subtree(sha256.from_bytes(digests), block.column("n")[0].as_py(), most)
    own = sha256.from_bytes([c or h for c, h in zip(block.column("changed").to_pylist(), digests, strict=True)])
    proof, blocks = sha256.start(len(digests)), np.zeros(len(digests), np.uint32)
    path = above.column("path")[0].as_py()
    steps = [path[k : k + STEP] for k in range(0, len(path), STEP)]
    same = lambda x: np.repeat(sha256.from_bytes([x]), len(digests), axis=1)
    higher = ((np.full(len(digests), s[0]), same(s[1:33]), same(s[33:])) for s in steps)
    for part in (tree.steps(), higher):
        for slot, state, sibling in part:
            own = _resumed(own, slot, state, sibling)
            has = slot != 1
            if has.any():
                proof[:, has] = sha256.extend(proof[:, has], sibling[:, has])
                blocks += has
    text = lambda d: [x.hex() for x in sha256.to_bytes(d)]
    out = {"doc_id": block.column("doc_id"), "leaf": pa.array([d.hex() for d in digests]), "subroot": pa.array([above.column("subroot")[0].as_py().hex()] * len(digests))}
    return pa.table(out | {"proof_sha256": pa.array(text(sha256.finish(proof, blocks))), "folded_root": pa.array(text(own))})


def _upward(nodes: DataFrame, most: int) -> list[DataFrame]:
    """Node tables (lang_key, pos, n, hash) of every round, up to the one in which each lang_key has a single node."""
    rounds = [nodes]
    while (rounds[-1].agg(F.max("n")).head()[0] or 1) > 1:
        blocks = rounds[-1].select("lang_key", "pos", "n", "hash").groupBy("lang_key", F.shiftright("pos", most))
        rounds.append(settled(blocks.applyInArrow(lambda block: _subroot(block, most), _NODE), "nodes"))
    return rounds


def _downward(rounds: list[DataFrame], paths: DataFrame, most: int) -> DataFrame:
    """(lang_key, pos, path) of the nodes of the first of some rounds, from the paths of the single nodes above them."""
    for nodes in reversed(rounds):
        blocks = nodes.select("lang_key", "pos", "n", "hash").groupBy("lang_key", F.shiftright("pos", most))
        paths = settled(blocks.cogroup(paths.groupBy("lang_key", "pos")).applyInArrow(lambda block, above: _paths(block, above, most), "lang_key string, pos bigint, path binary"), "paths")
    return paths


def manifest(documents: DataFrame, changed: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root of every row; ``changed`` is the leaf that a row is folded from (null: its own)."""
    spark, most = documents.sparkSession, BLOCK
    key = F.concat(F.when(F.col("lang").isNull(), "0").otherwise("1"), F.coalesce("lang", F.lit(""))).alias("lang_key")
    digest = F.unhex(leaf()).alias("hash")
    other = F.unhex(F.lit(None).cast("string") if changed is None else changed).alias("changed")
    with batch_rows(spark, 1 << 14):
        leaves = settled(numbered(documents.select("doc_id", key, digest, other), ["doc_id", "hash"]), "leaves")
        rounds = _upward(leaves, most)
        subroots = rounds[-1].select(F.lit("").alias("lang_key"), F.col("lang_key").alias("of"), "hash")
        subroots = settled(numbered(subroots, ["of"]), "subroots")
        tops = _upward(subroots, most)
        top = tops[-1].select(F.hex("hash")).head()
        root = F.lit(top[0].lower() if top else None)
        none = F.lit(b"").alias("path")
        ways = _downward(tops[:-1], tops[-1].select("lang_key", "pos", none), most).select("pos", "path")
        above = subroots.select("pos", F.col("of").alias("lang_key"), F.col("hash").alias("subroot")).join(ways, "pos")
        subroot = above.select("lang_key", "subroot")
        above = above.select("lang_key", F.lit(0).cast("bigint").alias("pos"), "path")
        above = _downward(rounds[1:-1], above, most).join(subroot, "lang_key")
        folded = leaves.groupBy("lang_key", F.shiftright("pos", most)).cogroup(above.groupBy("lang_key", "pos"))
        out = settled(folded.applyInArrow(lambda block, top: _folded(block, top, most), "doc_id bigint, leaf string, subroot string, proof_sha256 string, folded_root string"), "manifest")
    return out.withColumn("root", root)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document, and whether a row still folds to the root after some have been tampered with."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    more = F.coalesce(F.try_add(F.col("n_chars"), F.lit(1)), F.col("n_chars"))
    tampered = F.when(in_fold("doc_id", TAMPER, 0) & F.col("n_chars").isNotNull(), leaf({"n_chars": more}))
    out = manifest(documents, tampered).withColumn("verified", F.col("folded_root") == F.col("root"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


ORACLE_SQL = f"""
WITH RECURSIVE given AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS k, sha256({" || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", '"text"')))}) AS leaf,
    sha256({" || ".join(map(_field, ("doc_id", "source", "lang", "(n_chars + 1)", '"text"')))}) AS other,
    xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) WHEN acc % 2 = 1 THEN xor(acc // 2, 3988292384) ELSE acc // 2 END), 4294967295) % 7 = 0 AND n_chars IS NOT NULL AS tampered
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY k) AS n FROM given
), tree AS (
  SELECT k, 0 AS level, pos, n, leaf AS h FROM leaves
  UNION ALL
  SELECT k, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY k, level, pos // 2, n
), subroots AS (
  SELECT k, h, row_number() OVER (ORDER BY k) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
), top AS (
  SELECT 0 AS level, pos, n, h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY level, pos // 2, n
), low AS (
  SELECT id, k, 0 AS level, pos, n, CASE WHEN coalesce(tampered, false) THEN other ELSE leaf END AS h, '' AS proof FROM leaves
  UNION ALL
  SELECT w.id, w.k, w.level + 1, w.pos // 2, (w.n + 1) // 2, sha256(CASE WHEN w.pos % 2 = 0 THEN w.h || coalesce(s.h, '') ELSE s.h || w.h END), w.proof || coalesce(s.h, '')
  FROM low w LEFT JOIN tree s ON s.k = w.k AND s.level = w.level AND s.pos = xor(w.pos, 1) WHERE w.n > 1
), high AS (
  SELECT l.id, 0 AS level, s.pos, s.n, l.h, l.proof, s.h AS subroot FROM low l JOIN subroots s ON s.k = l.k WHERE l.n = 1
  UNION ALL
  SELECT w.id, w.level + 1, w.pos // 2, (w.n + 1) // 2, sha256(CASE WHEN w.pos % 2 = 0 THEN w.h || coalesce(s.h, '') ELSE s.h || w.h END), w.proof || coalesce(s.h, ''), w.subroot
  FROM high w LEFT JOIN top s ON s.level = w.level AND s.pos = xor(w.pos, 1) WHERE w.n > 1
)
SELECT l.doc_id, l.leaf, w.subroot, t.h AS root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = t.h AS verified
FROM leaves l JOIN high w ON w.id = l.id AND w.n = 1, (SELECT h FROM top WHERE n = 1) t
"""
