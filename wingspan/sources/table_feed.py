"""A change feed read from a table by high-water mark.

A table of Parquet files in which rows are added and updated (the writer gives each change a new ``updated_at``) is
read as a stream: the source ``table_feed`` of Spark's Python Data Source API. Its offset is a composite mark
``(updated_at, key)``, and a batch holds the rows after the mark before it, up to its own. So the rows of one instant may be
split over two batches, and none is lost or comes twice; the mark is kept in the query's checkpoint, so a restart reads on
from there. A batch takes all there is, or with ``max_rows`` the first so many (and rows alike to its last): then a
continuous query takes one batch after the other, while one run of the trigger ``availableNow`` takes a single batch.

The driver plans from Parquet footers. To place a batch's end it reads the keys of the newest row groups, or with ``max_rows``
the times and keys of the first ones in order of time, about ``max_rows`` and a row group's at a time; write timestamps as
microseconds, whose ranges footers hold. Tasks read the row groups whose times overlap the batch, only those,
and hand rows on as Arrow batches.

    spark.dataSource.register(TableFeed)
    spark.readStream.format("table_feed").options(path=..., updated_at="updated_at", key="flight_id").schema(...).load()

A row is a change if its ``updated_at`` and key are not null; others are in no batch. The key is an integer column that
tells rows of one instant apart; rows alike in both come in the same batch. A row that a writer adds later with a time or
key before the mark is not seen: let the feed lag behind the writers with ``settle_seconds``, which holds back everything
that is no older than so much before the newest change in the table. An empty or missing folder gives no batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Whole rows that a task reads at a time.
PIECE_ROWS = 1 << 16
#: The mark before every row.
START = (-(1 << 63), -(1 << 63))


@dataclass
class RowGroups(InputPartition):
    """Row groups of one file, and the marks between which rows are in the batch (after the first, up to the last)."""

    path: str
    groups: list[int]
    after: tuple[int, int]
    upto: tuple[int, int]

    def __init__(self, path: str, groups: list[int], after: tuple[int, int], upto: tuple[int, int]) -> None:
        super().__init__(0)
        self.path, self.groups, self.after, self.upto = path, groups, after, upto


def _micros(times: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return times.cast(pa.timestamp("us", tz=times.type.tz)).cast(pa.int64()).to_numpy(zero_copy_only=False)


def _between(t: np.ndarray, k: np.ndarray, after: tuple[int, int], upto: tuple[int, int]) -> np.ndarray:
    later = (t > after[0]) | ((t == after[0]) & (k > after[1]))
    return later & ((t < upto[0]) | ((t == upto[0]) & (k <= upto[1])))


class FeedReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema = schema
        self.path = options["path"].removeprefix("file:")
        self.updated_at, self.key = options["updated_at"], options["key"]
        self.max_rows = int(options.get("max_rows", 0))
        self.settle = int(float(options.get("settle_seconds", 0)) * 1_000_000)
        self.most_groups = int(options.get("groups_per_task", 8))
        self.mark = START
        self.told: dict[tuple, tuple[int, int]] = {}

    # marks as Spark keeps them
    def initialOffset(self) -> dict:  # noqa: N802
        return {"updated_at": START[0], "key": START[1]}

    def latestOffset(self) -> dict:  # noqa: N802
        self.mark = max(self.mark, self._next(self.mark))
        return {"updated_at": self.mark[0], "key": self.mark[1]}

    def _groups(self) -> list[tuple[str, int, int, int, int]]:
        """(file, row group, rows, least, greatest time). Of a group whose footer doesn't tell its times (the old 96-bit
        timestamps) the one column is read, once by a reader."""
        try:
            found = ds.dataset(self.path, format="parquet")
        except FileNotFoundError:
            return []
        out = []
        for fragment in found.get_fragments():
            footer = fragment.metadata
            at = footer.schema.names.index(self.updated_at)
            for g in range(footer.num_row_groups):
                stats = footer.row_group(g).column(at).statistics
                if stats is not None and stats.physical_type != "INT96" and stats.has_min_max:
                    low, high = _micros(pa.array([stats.min, stats.max], found.schema.field(self.updated_at).type)).tolist()
                elif (place := (fragment.path, footer.serialized_size, footer.num_rows, g)) in self.told:
                    low, high = self.told[place]
                else:
                    times = [t for _, t, _ in self._marks(fragment.path, [g])][0]
                    low, high = self.told[place] = (int(times.min()), int(times.max())) if len(times) else (1, 0)
                if low <= high:
                    out.append((fragment.path, g, footer.row_group(g).num_rows, low, high))
        return out

    def _marks(self, path: str, groups: list[int], columns: list[str] | None = None) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
        """Row groups one at a time, without rows that have no time or key, with their times and keys.

        With ``columns`` a row group comes in pieces of ``PIECE_ROWS`` rows, so a task holds few whole rows at once."""
        fragment = ds.dataset(path, format="parquet")
        for piece in next(fragment.get_fragments()).split_by_row_group():
            if piece.row_groups[0].id in groups:
                if columns is None:
                    parts = [piece.to_table(columns=[self.updated_at, self.key])]
                else:
                    scan = piece.to_batches(columns=columns, batch_size=PIECE_ROWS, batch_readahead=1, use_threads=False)
                    parts = (pa.Table.from_batches([b]) for b in scan if b.num_rows)
                for rows in parts:
                    rows = rows.filter(pc.and_(pc.is_valid(rows[self.updated_at]), pc.is_valid(rows[self.key])))
                    yield rows, _micros(rows[self.updated_at]), rows[self.key].cast(pa.int64()).to_numpy()

    def _next(self, after: tuple[int, int]) -> tuple[int, int]:
        """The mark that ends the batch after ``after``: that of its ``max_rows``-th row, or the last that has settled."""
        groups = self._groups()
        if not groups:
            return after
        end = max(g[4] for g in groups) - self.settle
        if not self.max_rows:
            if self.settle:
                return end, (1 << 63) - 1
            newest = [k[t == end] for path, g, _, _, high in groups if high == end for _, t, k in self._marks(path, [g])]
            return max(((end, int(k.max())) for k in newest if len(k)), default=after)
        open_ = [g for g in groups if g[4] >= after[0] and g[3] <= end]
        # Groups in order of their first time. All rows of the batch lie in the first groups that hold max_rows rows, or in
        # groups that begin no later than those end; more are never looked at.
        open_.sort(key=lambda g: g[3])
        held, counted, best = np.zeros((0, 2), np.int64), 0, None
        for path, group, _, low, _ in open_:
            if best is not None and low > best[0]:
                break
            for _, t, k in self._marks(path, [group]):
                inside = _between(t, k, after, (end, (1 << 63) - 1))
                held = np.concatenate([held, np.column_stack([t[inside], k[inside]])])
            if len(held) > self.max_rows:
                order = np.lexsort((held[:, 1], held[:, 0]))
                best = tuple(held[order[self.max_rows - 1]].tolist())
                held = held[_between(held[:, 0], held[:, 1], START, best)]
            counted = len(held)
        if not counted:
            return after
        return best if best is not None else max(map(tuple, held[np.lexsort((held[:, 1], held[:, 0]))][-1:].tolist()))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, upto = ((o["updated_at"], o["key"]) for o in (start, end))
        self.mark = max(self.mark, upto)
        of_file: dict[str, list[int]] = {}
        for path, group, _, low, high in self._groups():
            if high >= after[0] and low <= upto[0]:
                of_file.setdefault(path, []).append(group)
        n = self.most_groups
        return [RowGroups(p, g[i : i + n], after, upto) for p, g in sorted(of_file.items()) for i in range(0, len(g), n)] or [RowGroups("", [], after, upto)]

    def read(self, partition: RowGroups) -> Iterator[pa.RecordBatch]:
        if not partition.groups:
            return
        target = to_arrow_schema(self.schema)
        for rows, t, k in self._marks(partition.path, partition.groups, target.names):
            inside = _between(t, k, partition.after, partition.upto)
            if inside.any():
                yield from rows.filter(pa.array(inside)).cast(target).combine_chunks().to_batches()

    def commit(self, end: dict) -> None:
        pass


class TableFeed(DataSource):
    """The source ``table_feed``; options: path, updated_at, key, max_rows, settle_seconds, groups_per_task."""

    @classmethod
    def name(cls) -> str:
        return "table_feed"

    def schema(self) -> str:
        raise ValueError("table_feed needs a declared schema")

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        missing = {"path", "updated_at", "key"} - set(self.options)
        if missing:
            raise ValueError(f"table_feed needs the options {sorted(missing)}")
        return FeedReader(schema, dict(self.options))


def table_changes(spark, path: str, schema: StructType, updated_at: str, key: str, **options):  # noqa: ANN001, ANN003, ANN201
    """The changes of the table at ``path`` as a streaming DataFrame."""
    spark.dataSource.register(TableFeed)
    reader = spark.readStream.format("table_feed").schema(schema)
    return reader.options(path=path, updated_at=updated_at, key=key, **{k: str(v) for k, v in options.items()}).load()
