"""A block of questions asked of a stored full-text index: bounds of its parts, and scores of a part's units for all questions at once.

What is shuffled of the index are its asked blocks, as numbers: a unit's id comes once a part and task of the scan, an
entry is its place among these and its weighted count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts of the best bounds that are scored first, to learn what the k-th best score is at least.
FIRST_PARTS = 4
#: Entries that a task of a scan holds at once, and bytes of masks that are broadcast.
ENTRIES, MASKS = 1 << 21, 1 << 25
PACKED = "turn int, part int, ids array<string>, lengths binary, words binary, sizes binary, units binary, tfs binary"
BOUNDS = "turn int, part int, bounds array<double>"


def best(rows: DataFrame, key: str, by: list, top: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*by))).where(F.col("rank") <= top)


def reaches(x: np.ndarray, floor: np.ndarray | float) -> np.ndarray:
    """Scores are ranked as rounded to 6 digits, so what is within that of the floor stays."""
    return x * (1 + 1e-9) + 2e-6 >= floor


@dataclass
class Asked:
    """Questions of a block. said: the numbers of a question's words; factors: what each of them weighs."""

    n_words: int
    said: list[np.ndarray]
    factors: list[np.ndarray]

    def sums(self, x: np.ndarray) -> list[float]:
        """x by word, added up by question."""
        return [float(f @ x[w]) for w, f in zip(self.said, self.factors)]

    def mask(self, chosen: np.ndarray) -> np.ndarray:
        """The words of chosen questions, a bit each."""
        bits = np.zeros(-(-self.n_words // 64) * 64, bool)
        for j in np.flatnonzero(chosen):
            bits[self.said[j]] = True
        return np.packbits(bits, bitorder="little").view("<i8")

    def split(self, caps: np.ndarray, floors: np.ndarray) -> tuple[Asked, np.ndarray]:
        """The questions with their leading words alone, and what the others, the common ones, add at most: less than the floor. caps: the largest bound of each word."""
        said, factors, rest = [], [], np.zeros(len(self.said))
        for j, (w, f) in enumerate(zip(self.said, self.factors)):
            order = np.lexsort((w, f * caps[w]))
            low = np.cumsum((f * caps[w])[order])
            common = int((~reaches(low, floors[j])).sum())  # they come first
            said.append(w[order[common:]])
            factors.append(f[order[common:]])
            rest[j] = low[common - 1] if common else 0.0
        return Asked(self.n_words, said, factors), rest


@dataclass
class Score:
    """BM25 over counts of fields, weighted."""

    weight: np.ndarray
    k1: float
    b: float
    mean: float

    def impact(self, tf, length):
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / self.mean))


def packed(weight: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks (turn, part, _w, entries) -> PACKED: of each part what some of the blocks hold, ENTRIES at about most."""

    def row_of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        turn, part, word = (rows.column(i).to_numpy() for i in range(3))
        lists = rows.column(3).combine_chunks()
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        names = pc.struct_field(flat, "id").dictionary_encode()
        length = pc.struct_field(flat, "length").to_numpy(zero_copy_only=False)
        tf = pc.struct_field(flat, "counts").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(weight)) @ weight
        place, of_row = np.unique(turn.astype(np.int64) << 32 | part, return_inverse=True)
        by_place = np.argsort(of_row, kind="stable")
        first_row = np.searchsorted(of_row[by_place], np.arange(len(place) + 1))
        of_entry = np.repeat(of_row, sizes)
        order = np.argsort(of_entry, kind="stable")
        of_entry, tf, length = of_entry[order], tf[order], length[order]
        unit, at, of_unit = np.unique(of_entry * len(names.dictionary) + names.indices.to_numpy()[order], return_index=True, return_inverse=True)
        first_unit = np.searchsorted(unit, np.arange(len(place) + 1) * len(names.dictionary))
        first = np.searchsorted(of_entry, np.arange(len(place) + 1))
        out: list[list] = [[] for _ in range(5)]
        for i in range(len(place)):
            r, u, e = by_place[first_row[i] : first_row[i + 1]], slice(first_unit[i], first_unit[i + 1]), slice(first[i], first[i + 1])
            units = (of_unit[e] - u.start).astype(np.min_scalar_type(u.stop - u.start))
            for x, values in zip(out, (length[at[u]].astype("i4"), word[r].astype("i4"), sizes[r].astype("i4"), units, tf[e].astype("f8"))):
                x.append(values.tobytes())
        ids = pa.ListArray.from_arrays(pa.array(first_unit, pa.int32()), names.dictionary.take(pa.array(unit % max(1, len(names.dictionary)))))
        columns = [pa.array(place >> 32, pa.int32()), pa.array(place & 0xFFFFFFFF, pa.int32()), ids, *(pa.array(x, pa.binary()) for x in out)]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PACKED.split(", ")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, entries = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                entries += len(batch.column(3).flatten())
            if entries >= ENTRIES:
                yield row_of(held)
                held, entries = [], 0
        if held:
            yield row_of(held)

    return pack


class PartScores:
    """The units of one part with what each asked word adds to them; old: ids that are out of date."""

    def __init__(self, rows: pa.Table, old: pa.Table, n_words: int, score: Score):
        names = rows.column("ids").combine_chunks().flatten().dictionary_encode()  # rows of several tasks name the same units
        unit_of, self.ids = names.indices.to_numpy(), names.dictionary
        length, words, units, tfs = np.zeros(len(self.ids)), [], [], []
        begin = 0
        for r in rows.select(["lengths", "words", "sizes", "units", "tfs"]).to_pylist():
            lengths = np.frombuffer(r["lengths"], "i4")
            here = unit_of[begin : begin + len(lengths)]
            begin += len(lengths)
            length[here] = lengths
            words.append(np.repeat(np.frombuffer(r["words"], "i4"), np.frombuffer(r["sizes"], "i4")))
            units.append(here[np.frombuffer(r["units"], np.min_scalar_type(len(lengths)))])
            tfs.append(np.frombuffer(r["tfs"], "f8"))
        word, unit, tf = (np.concatenate(x) for x in (words, units, tfs))
        known, word = np.unique(word, return_inverse=True)
        adds = score.impact(tf, length[unit])
        self.adds = np.bincount(word * len(self.ids) + unit, weights=adds, minlength=len(known) * len(self.ids)).reshape(len(known), len(self.ids))
        self.place = np.full(n_words, -1)
        self.place[known] = np.arange(len(known))
        if old.num_rows:
            self.adds[:, pc.is_in(self.ids, value_set=old.column("id").combine_chunks()).to_numpy(zero_copy_only=False)] = 0.0

    def of(self, said: np.ndarray, factors: np.ndarray) -> np.ndarray:
        at = self.place[said]
        return factors[at >= 0] @ self.adds[at[at >= 0]]


class Answer:
    """The best k units of each question of a block. blocks: those the index has of their words, with the word's number _w; stale: (turn, part, id) of units out of date."""

    def __init__(self, blocks: DataFrame, stale: DataFrame, asked: Asked, score: Score, k: int, write: Callable[[DataFrame, str], DataFrame]):
        self.blocks, self.stale, self.asked, self.score, self.k, self.write = blocks, stale, asked, score, k, write
        at_most = sum((F.col("most")[i] * float(w) for i, w in enumerate(score.weight)), F.lit(0.0))
        self.heads = write(blocks.select("_w", "turn", "part", "n", score.impact(at_most, F.col("least")).alias("impact")), "heads")

    def parts(self) -> DataFrame:
        """BOUNDS: of each part, what a unit can score for each question at most."""
        asked = self.asked

        def bounds(rows: pa.Table) -> pa.Table:
            x = np.zeros(asked.n_words)
            x[rows.column("_w").to_numpy()] = rows.column("impact").to_numpy()
            return pa.table([*(rows.column(c).slice(0, 1) for c in ("turn", "part")), pa.array([asked.sums(x)], pa.list_(pa.float64()))], names=["turn", "part", "bounds"])

        return self.write(self.heads.groupBy("turn", "part").applyInArrow(bounds, BOUNDS), "parts")

    def masks(self, parts: DataFrame, asked: Asked, chosen: Callable[[int, int, np.ndarray], np.ndarray], name: str) -> DataFrame:
        """(turn, part, mask): which words' blocks of a part chosen questions need. parts: BOUNDS."""

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bounds = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                found = [(t, p, asked.mask(c)) for t, p, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bounds) if (c := chosen(t, p, x)).any()]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found), (pa.int32(), pa.int32(), pa.list_(pa.int64())))], names=["turn", "part", "mask"])

        return self.write(parts.mapInArrow(of, "turn int, part int, mask array<bigint>"), name)

    def needed(self, rows: DataFrame, masks: DataFrame) -> DataFrame:
        """rows (_w, turn, part, ...) of blocks that masks have. Of masks there is one a part; beyond MASKS bytes they and the blocks are shuffled by part."""
        small = masks.count() * (self.asked.n_words // 8 + 64) <= MASKS
        bit = F.getbit(F.get("mask", F.shiftright("_w", 6)), F.col("_w").bitwiseAND(63))
        return rows.join(masks.hint("broadcast" if small else "shuffle_hash"), ["turn", "part"]).where(bit == 1).drop("mask")

    def by_part(self, masks: DataFrame, of_part: Callable[[int, int, PartScores], pa.Table], schema: str) -> DataFrame:
        """of_part of each part's scores. The blocks are read, shuffled once as PACKED and met with ids that are out of date."""
        n_words, score = self.asked.n_words, self.score
        rows = self.needed(self.blocks.select("turn", "part", "_w", "entries"), masks).select("turn", "part", "_w", "entries").mapInArrow(packed(score.weight), PACKED)

        def of(rows: pa.Table, old: pa.Table) -> pa.Table:
            if not rows.num_rows:  # a part that no question needs
                return table_of([], schema)
            return of_part(rows.column("turn")[0].as_py(), rows.column("part")[0].as_py(), PartScores(rows, old, n_words, score))

        return rows.groupBy("turn", "part").cogroup(self.stale.groupBy("turn", "part")).applyInArrow(of, schema)

    def ranked(self, masks: DataFrame, floors: np.ndarray, tried: dict[tuple[int, int], list[int]] | None = None) -> DataFrame:
        """(_q, id, score): of each question and part the best k that reach the question's floor, ties by id. tried: the parts' questions, if not all."""
        asked, k = self.asked, self.k

        def of_part(turn: int, part: int, scores: PartScores) -> pa.Table:
            found: list[tuple] = []
            for j in range(len(asked.said)) if tried is None else tried.get((turn, part), []):
                s = scores.of(asked.said[j], asked.factors[j])
                i = np.flatnonzero((s > 0) & (s >= floors[j] - 1e-6))
                rounded = np.floor(s[i] * 1e6 + 0.5) / 1e6
                i, rounded = i[rounded >= floors[j]], rounded[rounded >= floors[j]]
                if len(i) > k:  # more than k equal ones stay, for their ids
                    fits = rounded >= np.partition(rounded, len(rounded) - k)[len(rounded) - k]
                    i, rounded = i[fits], rounded[fits]
                rows = list(zip(rounded.tolist(), scores.ids.take(pa.array(i)).to_pylist()))
                found += [(j, x, r) for r, x in (sorted(rows, key=lambda x: (-x[0], x[1]))[:k] if len(rows) > k else rows)]
            return table_of(found, "_q int, id string, score double")

        return self.by_part(masks, of_part, "_q int, id string, score double")

    def hopeful(self, masks: DataFrame, leading: Asked, rest: np.ndarray, floors: np.ndarray) -> DataFrame:
        """BOUNDS of the parts where a unit can reach a question's floor, as its leading words score; 0 for other questions."""

        def of_part(turn: int, part: int, scores: PartScores) -> pa.Table:
            most = np.array([scores.of(w, f).max(initial=0.0) for w, f in zip(leading.said, leading.factors)])
            bounds = np.where((most > 0) & reaches(most + rest, floors), most + rest, 0.0)
            return table_of([(turn, part, bounds.tolist())] if bounds.any() else [], BOUNDS)

        return self.write(self.by_part(masks, of_part, BOUNDS), "hopeful")

    def found(self) -> tuple[DataFrame, DataFrame]:
        """(_q, id, score), at least the best k of each question; the blocks that were read (_q, _w, turn, part)."""
        parts, n = self.parts(), len(self.asked.said)
        by_question = parts.select("turn", "part", F.posexplode("bounds").alias("_q", "bound")).where("bound > 0")
        tried: dict = {}
        for r in best(by_question, "_q", [F.desc("bound"), "turn", "part"], FIRST_PARTS).collect():  # FIRST_PARTS a question
            tried.setdefault((r["turn"], r["part"]), []).append(r["_q"])
        trying = lambda turn, part, x: np.isin(np.arange(n), tried.get((turn, part), []))
        first = self.ranked(self.masks(parts, self.asked, trying, "tried"), np.full(n, -np.inf), tried)
        floors = np.full(n, -np.inf)
        for r in best(first, "_q", [F.desc("score"), "id"], self.k).where(F.col("rank") == self.k).collect():
            floors[r["_q"]] = r["score"]
        caps = np.zeros(self.asked.n_words)
        for r in self.heads.groupBy("_w").agg(F.max("impact").alias("cap")).collect():  # the block's words at most
            caps[r["_w"]] = r["cap"]
        leading, rest = self.asked.split(caps, floors)
        alive = lambda turn, part, x: (x > 0) & reaches(x, floors)
        masks, read = self.masks(parts, self.asked, alive, "alive"), self.read(parts, self.asked, floors)
        if rest.any():
            lead = self.masks(parts, leading, alive, "leading")
            least, most = (self.needed(self.heads, m).agg(F.sum("n")).first()[0] or 0 for m in (lead, masks))
            if 2 * least < most:
                left = self.hopeful(lead, leading, rest, floors)
                masks = self.masks(left, self.asked, alive, "left")
                read = self.read(parts, leading, floors).unionByName(self.read(left, self.asked, floors)).distinct()
        return self.ranked(masks, floors), read

    def theirs(self, asked: Asked) -> DataFrame:
        """(_q, _w, turn, part): the blocks that the index has of questions' words."""
        pairs = [(j, int(w)) for j, said in enumerate(asked.said) for w in said]
        return self.heads.join(F.broadcast(self.heads.sparkSession.createDataFrame(pairs, "_q int, _w int")), "_w").select("_q", "_w", "turn", "part")

    def read(self, parts: DataFrame, asked: Asked, floors: np.ndarray) -> DataFrame:
        least = F.broadcast(parts.sparkSession.createDataFrame(list(enumerate(floors.tolist())), "_q int, floor double"))
        by_question = parts.select("turn", "part", F.posexplode("bounds").alias("_q", "bound")).join(least, "_q").where((F.col("bound") > 0) & reaches(F.col("bound"), F.col("floor")))
        return self.theirs(asked).join(by_question, ["_q", "turn", "part"], "left_semi")


KINDS = {"int": pa.int32(), "string": pa.string(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}


def table_of(rows: list[tuple], schema: str) -> pa.Table:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.table([pa.array(x, KINDS[kind]) for x, kind in zip(columns, kinds)], names=list(names))
