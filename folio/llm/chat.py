"""Transcript parsing: roles by a hidden Markov model, then canonical turns.

A block is a turn's text, or the lines of a raw transcript between blank
lines or speaker markers. Roles are hidden; seen are the speaker marker of
the first line, the length, the number of lines and a closing question mark.
Counts over all labelled blocks give the model. Viterbi decoding is a product
of (max, +) matrices, and so is split: blocks are sorted by ranges over all
tasks, a conversation's run in a range is a part, and a part is cut into
chunks of CHUNK blocks. A chunk gives the best score from any role before it
to any role at its end; these small matrices are multiplied for each part,
then joined over a conversation's parts, and parts and chunks are decoded
between the roles that were found. No conversation must fit a task, whatever
its turns' numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.common import cut

ROLES = ("user", "assistant", "system")
CHUNK = 64
#: Speaker markers at the start of a line, by the role they stand for.
MARKERS = {"user": r"user|human|question|q|customer|prompt", "assistant": r"assistant|ai|bot|answer|a|agent|response", "system": r"system|instructions?|context"}
_HEAD = r"(?i)^\s*(?:#{1,4}\s*|<\|(?:im_start\|>)?|\[|\*\*)?(?:%s)(?:\s*(?:\|>|\]|:\*\*|\*\*:|:|>)\s*|\s*\n)"
_MARGIN = _HEAD % "|".join(MARKERS.values())
#: Values of each feature: marker, length, lines, question.
SIZES = (4, 12, 4, 2)


def _features(text: Column) -> Column:
    marker = F.when(text.rlike(_HEAD % MARKERS["user"]), 1).when(text.rlike(_HEAD % MARKERS["assistant"]), 2).when(text.rlike(_HEAD % MARKERS["system"]), 3).otherwise(0)
    words = F.size(F.split(F.trim(text), r"\s+"))
    lines = F.size(F.split(text, "\n"))
    return F.array(marker, F.least(F.floor(F.log2(words.cast("double"))), F.lit(SIZES[1] - 1)).cast("int"), F.least(lines, F.lit(4)) - 1, text.rlike(r"\?\s*\z").cast("int"))


def blocks_of_transcripts(transcripts: DataFrame) -> DataFrame:
    """conv_id, turn, text of raw transcripts (conv_id, text): a blank line or a speaker marker begins a block."""
    # A form feed marks the borders; the rest of the text keeps its form.
    text = F.regexp_replace(F.translate(F.coalesce("text", F.lit("")), "\f", " "), r"\n\s*\n", "\f")
    text = F.regexp_replace(text, "\n(?=" + _MARGIN.replace("(?i)^", "(?i)") + ")", "\f")
    found = transcripts.select("conv_id", F.posexplode(F.split(text, "\f")).alias("turn", "text"))
    return found.where(F.trim("text") != "").select("conv_id", F.col("turn").cast("long").alias("turn"), "text")


def chunked(blocks: DataFrame) -> DataFrame:
    """conv_id, part, chunk, blocks (array of turn, features, role, text in order), at most CHUNK of them.

    Turns are in order by number, null first; equal ones by the hash of their
    text. They are sorted over all tasks by ranges, so a conversation with any
    number of turns, numbered or not, is spread over parts: its runs in one
    range. Chunks are cut by place within a part, not by the turn's number.
    """
    role = F.col("role") if "role" in blocks.columns else F.lit(None).cast("string")
    rows = blocks.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.lower(role).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Repeated rows differ in nothing but the salt, which is written down before rows are dealt by it.
    rows = cut(rows.withColumn("features", _features(F.col("text"))).withColumn("tie", F.xxhash64("text")).withColumn("salt", F.monotonically_increasing_id()))
    order = ["conv_id", "turn", "tie", "salt"]
    rows = cut(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    place = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy("turn", "tie", "salt")) - 1
    rows = rows.withColumn("place", place).withColumn("chunk", F.floor(F.col("place") / CHUNK))
    listed = F.sort_array(F.collect_list(F.struct("place", "turn", "text", "features", "role")))
    return rows.groupBy("conv_id", "part", "chunk").agg(listed.alias("blocks"))


def _borders(chunks: DataFrame) -> DataFrame:
    """before, first: the roles on both sides of every border of chunks; start is true where a conversation begins."""
    ends = chunks.select("conv_id", "part", "chunk", F.col("blocks")[0]["role"].alias("first"), F.element_at("blocks", -1)["role"].alias("last"))

    def along(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(order)
        return rows.select(F.lag("last").over(w).alias("before"), "first", (F.row_number().over(w) == 1).alias("start"))

    # Chunks of a part, then parts of a conversation, which are no more than there are tasks.
    parts = ends.groupBy("conv_id", "part").agg(F.min_by("first", "chunk").alias("first"), F.max_by("last", "chunk").alias("last"))
    return along(ends, ["conv_id", "part"], "chunk").where("not start").unionByName(along(parts, ["conv_id"], "part"))


def train(chunks: DataFrame, smoothing: float = 0.5) -> dict[str, list]:
    """Log probabilities from counts over all labelled blocks; a few dozen numbers reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = Counter()
        for batch in batches:
            for blocks in batch.blocks:
                before = None
                for b in blocks:
                    role = ROLES.index(b["role"]) if b["role"] in ROLES else None
                    if role is not None:
                        if before is not None:
                            found["next", before, role] += 1
                        for k, v in enumerate(b["features"]):
                            found[f"f{k}", role, int(v)] += 1
                    before = role
        yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["what", "a", "b", "n"])

    inside = chunks.select("blocks").mapInPandas(count, "what string, a int, b int, n long")
    number = lambda c: F.array_position(F.array(*map(F.lit, ROLES)), F.col(c)).cast("int") - 1
    between = _borders(chunks).select(F.when(F.col("start"), "first").otherwise("next").alias("what"), number("before").alias("a"), number("first").alias("b"), "start").where("b >= 0 and (start or a >= 0)")
    between = between.select("what", F.when(F.col("start"), F.col("b")).otherwise(F.col("a")).alias("a"), F.when(F.col("start"), 0).otherwise(F.col("b")).alias("b"), F.lit(1).cast("long").alias("n"))
    totals = inside.unionByName(between).groupBy("what", "a", "b").agg(F.sum("n").alias("n"))
    counts = {(r["what"], r["a"], r["b"]): r["n"] for r in totals.toLocalIterator()}

    def table(what: str, rows: int, columns: int) -> list:
        t = np.array([[counts.get((what, a, b), 0) + smoothing for b in range(columns)] for a in range(rows)])
        return np.log(t / t.sum(axis=1, keepdims=True)).tolist()

    first = np.array([counts.get(("first", r, 0), 0) + smoothing for r in range(len(ROLES))])
    return {"first": np.log(first / first.sum()).tolist(), "next": table("next", len(ROLES), len(ROLES)), "seen": [table(f"f{k}", len(ROLES), n) for k, n in enumerate(SIZES)]}


def _emissions(model: dict, blocks) -> np.ndarray:
    seen = [np.array(t) for t in model["seen"]]
    return np.array([sum(seen[k][:, int(v)] for k, v in enumerate(b["features"])) for b in blocks])


def _matrix(model: dict, blocks) -> np.ndarray:
    """Best score from the role before the chunk to the role at its end."""
    step, out = np.array(model["next"]), None
    for e in _emissions(model, blocks):
        one = step + e[None, :]
        out = one if out is None else (out[:, :, None] + one[None, :, :]).max(axis=1)
    return out


def _decode(model: dict, blocks, before: int | None, last: int) -> list[int]:
    """Viterbi from the role before (None at the start) to the role at the end."""
    step, emissions = np.array(model["next"]), _emissions(model, blocks)
    score, back = (np.array(model["first"]) if before is None else step[before]) + emissions[0], []
    for e in emissions[1:]:
        ways = score[:, None] + step
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0) + e
    roles = [last]
    for b in reversed(back):
        roles.append(int(b[roles[-1]]))
    return roles[::-1]


def _over(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Best scores over successive parts: to the role at the end, from the conversation's start and from the role before."""
    start, steps = np.array(parts[0]["start"]), np.array(parts[0]["steps"]).reshape(len(ROLES), -1)
    for p in parts[1:]:
        one = np.array(p["steps"]).reshape(len(ROLES), -1)
        start, steps = (start[:, None] + one).max(axis=0), (steps[:, :, None] + one[None, :, :]).max(axis=1)
    return start, steps


def _ends(parts: list, before: int | None = None, last: int | None = None) -> list[int]:
    """Roles at the ends of successive parts, from the role before (None at the start) to the role at the end (None: the best)."""
    score, back = np.array(parts[0]["start"] if before is None else np.array(parts[0]["steps"]).reshape(len(ROLES), -1)[before]), []
    for p in parts[1:]:
        ways = score[:, None] + np.array(p["steps"]).reshape(len(ROLES), -1)
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0)
    roles = [int(score.argmax()) if last is None else last]
    for b in reversed(back):
        roles.append(int(b[roles[-1]]))
    return roles[::-1]


def parse(chunks: DataFrame, model: dict) -> DataFrame:
    """conv_id, turn, role, rendered for every block.

    Of equal scores the role listed first wins. A null text is an empty
    block; a null conv_id is a conversation; repeated rows are repeated
    turns; turns without a number come first; an empty table gives none.
    """

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conv, part, chunk, blocks in batch.itertuples(index=False):
                first = np.array(model["first"]) + _emissions(model, blocks[:1])[0]
                rest = _matrix(model, blocks[1:]) if len(blocks) > 1 else None
                start = first if rest is None else (first[:, None] + rest).max(axis=0)
                rows.append((conv, part, chunk, start.tolist(), _matrix(model, blocks).ravel().tolist()))
            yield pd.DataFrame(rows, columns=["conv_id", "part", "chunk", "start", "steps"]).astype({"conv_id": "Int64"})

    bare = F.transform("blocks", lambda b: F.struct(b["features"].alias("features")))
    ends = chunks.select("conv_id", "part", "chunk", bare.alias("blocks")).mapInPandas(matrices, "conv_id long, part int, chunk long, start array<double>, steps array<double>")
    # Chunks of a part and parts of a conversation, without their texts: no list is longer than a part's chunks or the number of tasks.
    listed = ends.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("chunk", "start", "steps"))).alias("parts"))

    def shorten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(conv, part, start.tolist(), steps.ravel().tolist()) for conv, part, parts in batch.itertuples(index=False) for start, steps in [_over(parts)]]
            yield pd.DataFrame(rows, columns=["conv_id", "part", "start", "steps"]).astype({"conv_id": "Int64"})

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conv, parts in batch.itertuples(index=False):
                roles = _ends(parts)
                rows += [(conv, p["part"], roles[i - 1] if i else -1, roles[i]) for i, p in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["p_id", "p_part", "p_before", "p_last"]).astype({"p_id": "Int64"})

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conv, part, parts, before, last in batch.itertuples(index=False):
                roles = _ends(parts, None if before < 0 else before, last)
                rows += [(conv, part, p["chunk"], roles[i - 1] if i else before, roles[i]) for i, p in enumerate(parts)]
            yield pd.DataFrame(rows, columns=["e_id", "e_part", "e_chunk", "before", "last"]).astype({"e_id": "Int64"})

    whole = listed.mapInPandas(shorten, "conv_id long, part int, start array<double>, steps array<double>")
    whole = whole.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "start", "steps"))).alias("parts"))
    at_parts = whole.mapInPandas(join, "p_id long, p_part int, p_before int, p_last int")
    met = listed.join(at_parts, F.col("conv_id").eqNullSafe(F.col("p_id")) & (F.col("part") == F.col("p_part"))).select("conv_id", "part", "parts", "p_before", "p_last")
    found = met.mapInPandas(spread, "e_id long, e_part int, e_chunk long, before int, last int")
    same = chunks["conv_id"].eqNullSafe(F.col("e_id")) & (chunks["part"] == F.col("e_part")) & (chunks["chunk"] == F.col("e_chunk"))
    joined = chunks.join(found, same).select("conv_id", "blocks", "before", "last")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conv, blocks, before, last in batch.itertuples(index=False):
                roles = _decode(model, blocks, None if before < 0 else before, last)
                rows += [(conv, b["turn"], ROLES[r], b["text"]) for b, r in zip(blocks, roles)]
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})

    turns = joined.mapInPandas(decode, "conv_id long, turn long, role string, text string")
    body = F.trim(F.regexp_replace("text", _MARGIN, ""))
    return turns.select("conv_id", "turn", "role", F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), body, F.lit("\n<|end|>")).alias("rendered"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, rendered of all blocks of a table with labels, none parsed by a model that saw its label.

    Conversations are dealt to two folds by the hash of their id; each fold is
    parsed by the model of the other. Where one fold is empty, the other is
    parsed by a model without counts. Edge cases as in ``parse``.
    """
    chunks = cut(chunked(conversations).withColumn("fold", F.pmod(F.xxhash64("conv_id"), F.lit(2))))
    folds = [chunks.where(F.col("fold") == k) for k in (0, 1)]
    return parse(folds[0], train(folds[1])).unionByName(parse(folds[1], train(folds[0])))
