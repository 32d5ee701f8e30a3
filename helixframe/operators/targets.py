"""Window operators of proteins: profiles, membrane regions, epitopes. Exact: scales are summed in tenths."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from helixframe.functions.tables import HYDROPATHY, HYDROPHILICITY

REGIONS = ArrayType(StructType().add("start", IntegerType()).add("end", IntegerType()).add("mean", DoubleType()))
#: Letters of the sequences whose rows are made at once.
PIECE = 250_000


def _tenths(seq: str, scale: dict[str, float]) -> np.ndarray:
    table = np.zeros(256, np.int64)
    for residue, value in scale.items():
        table[ord(residue)] = round(10 * value)
    return table[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]


def _windows(values: np.ndarray, width: int) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[width:] - total[:-width] if len(values) >= width else np.zeros(0, np.int64)


def flat_rows(sequences: DataFrame, columns: Callable[[str], list[np.ndarray]], schema: str) -> DataFrame:
    """(doc_id, and the rows that ``columns`` makes of each sequence), in pieces of bounded size. Null sequences have none."""
    kind = sequences.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            low, letters = 0, 0
            for at in range(batch.num_rows):
                letters += len(texts[at].as_py() or "")
                if letters >= PIECE or at + 1 == batch.num_rows:
                    own = [columns(t) for t in texts.slice(low, at + 1 - low).to_pylist() if t]
                    lengths = iter([len(x[0]) for x in own])
                    take = np.repeat(np.arange(low, at + 1), [next(lengths) if t else 0 for t in texts.slice(low, at + 1 - low).to_pylist()])
                    if own:
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(take)), *(pa.array(np.concatenate(x)) for x in zip(*own, strict=True))], ["doc_id", *(c.split()[0] for c in schema.split(", "))])
                    low, letters = at + 1, 0

    return sequences.select("doc_id", "seq").mapInArrow(run, f"doc_id {kind}, {schema}")


def hydrophilicity(sequences: DataFrame) -> DataFrame:
    """(doc_id, pos, mean): the centred mean over seven residues, fewer at the ends."""

    def profile(s: str) -> list[np.ndarray]:
        v = _tenths(s, HYDROPHILICITY)
        total, at = np.concatenate([[0], np.cumsum(v)]), np.arange(len(v))
        low, high = np.maximum(at - 3, 0), np.minimum(at + 4, len(v))
        return [at.astype(np.int32), (total[high] - total[low]) / (10.0 * (high - low))]

    return flat_rows(sequences, profile, "pos int, mean double")


def membrane_runs(seq: str, width: int = 19, least: float = 1.6) -> list[tuple[int, int, float]]:
    v = _tenths(seq, HYDROPATHY)
    hit = np.flatnonzero(_windows(v, width) >= round(10 * least * width))
    edge = np.zeros(len(v) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + width, -1)
    inside = np.concatenate([[0], (np.cumsum(edge)[: len(v)] > 0).astype(np.int64), [0]])
    starts, ends = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
    return [(int(a), int(b), float(v[a:b].sum() / (10.0 * (b - a)))) for a, b in zip(starts, ends, strict=True)]


@F.pandas_udf(REGIONS)
def membrane_regions(seq: pd.Series) -> pd.Series:
    """Runs of residues that lie in a window of 19 with a mean hydropathy of 1.6 or more."""
    return seq.map(lambda s: [{"start": a, "end": b, "mean": m} for a, b, m in membrane_runs(s)])


def epitope_runs(seq: str, width: int = 9, least: float = 55.0) -> list[np.ndarray]:
    """All windows (starts, scores, exposed, kept) that score ``least`` or more; kept are the best first, ties by start, none
    overlapping a better one."""
    sums = _windows(_tenths(seq, HYDROPHILICITY), width)
    score = np.clip((sums / (10.0 * width) + 10) / 20 * 100, 0, 100)
    starts = np.flatnonzero(score >= least)
    covered = np.zeros(len(seq) + 1, bool)
    for a, b, _ in membrane_runs(seq):
        covered[a:b] = True
    inside = np.concatenate([[0], np.cumsum(covered)])
    exposed = (inside[starts + width] == inside[starts]) & (sums[starts] > 0)
    taken, kept, mark = bytearray(len(seq) + 1), np.zeros(len(starts), bool), bytes([1]) * width
    for i in np.lexsort((starts, -score[starts])).tolist():
        s = int(starts[i])
        if taken.find(1, s, s + width) < 0:
            taken[s : s + width] = mark
            kept[i] = True
    return [starts.astype(np.int32), score[starts], exposed, kept]


def epitopes(sequences: DataFrame) -> DataFrame:
    """(doc_id, start, score, exposed, kept): the windows of ``epitope_runs``, a row each."""
    return flat_rows(sequences, epitope_runs, "start int, score double, exposed boolean, kept boolean")


@F.pandas_udf(IntegerType())
def target_count(seq: pd.Series) -> pd.Series:
    """The number of kept and exposed windows."""

    def number(s: str) -> int:
        _, _, exposed, kept = epitope_runs(s)
        return int((exposed & kept).sum())

    return seq.map(number)


def vaccine_targets(windows: DataFrame, top: int = 8) -> DataFrame:
    """The ``top`` exposed kept windows of each protein, best first."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "start"))
    return windows.where("kept and exposed").withColumn("rank", rank).where(F.col("rank") <= top)
