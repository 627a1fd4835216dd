"""Streaming forms of admission and deduplication.

Late rows fall out by watermark, as the batch window drops them; an address seen
within the watermark is dropped. ``exact_changes`` is the whole first phase on a stream: rows of
equal address, or of equal title at one host, are one group, also through others, and a group's preferred row is
announced, and taken back when a better one comes or two groups turn out to be one.
Edges of the first phase never leave a host, so state per host is exact.
"""

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewire.functions import urls
from tidewire.operators.dedupe import preference_key

#: The state store that ``exact_changes`` needs: settings of the session.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

#: Into how many states the titles of one host are dealt.
PARTS = 1024


def admit(candidates: DataFrame, hours: int = 120) -> DataFrame:
    """Rows within the watermark, each canonical address once."""
    return candidates.withWatermark("published_at", f"{hours} hours").dropDuplicatesWithinWatermark(["canonical_url"])


def against_history(candidates: DataFrame, history: DataFrame) -> DataFrame:
    """Stream-static anti-join with addresses already published."""
    return candidates.join(history.select("canonical_url").distinct(), "canonical_url", "left_anti")


def first_titles(candidates: DataFrame, hours: int = 120, parts: int = PARTS) -> DataFrame:
    """(host, id, folded, source_weight): emits a row whenever its title is new at a host or outweighs the one kept.

    ``candidates`` has canonical_url, folded, id, source_weight and published_at.
    A host's titles are dealt by their hash into ``parts``, each of which is one state: the best weight of
    each of its titles, and until when that is kept. So a busy host is many small states, and a call of Python
    serves many titles; a title that is quiet for the window is forgotten.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        kept = {t: (w, until) for t, w, until in json.loads(state.get[0])} if state.exists else {}
        best: dict = {}
        for pdf in () if state.hasTimedOut else batches:
            for title, weight, i, at in zip(*(pdf[c].tolist() for c in ("folded", "source_weight", "id", "published_at")), strict=True):
                weight = None if pd.isna(weight) else int(weight)
                rank = (weight is None, -(weight or 0), i)
                first, latest = best.get(title, (rank, now))
                best[title] = min(first, rank), latest if pd.isna(at) else max(latest, int(at.timestamp() * 1000))
        out = []
        for title, ((none, weight, i), latest) in best.items():
            weight, held = None if none else -weight, kept.get(title)
            if held is None or weight is not None and (held[0] is None or held[0] < weight):
                out.append((key[0], i, title, weight))
            else:
                weight = held[0]
            kept[title] = weight, latest + hours * 3_600_000
        left = [(t, w, until) for t, (w, until) in kept.items() if until >= now]
        if left:
            state.update((json.dumps(left),))
            state.setTimeoutTimestamp(min(until for _, _, until in left))
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["host", "id", "folded", "source_weight"]).astype({"source_weight": "Int32"})

    part = F.pmod(F.xxhash64("folded"), F.lit(parts)).cast("int").alias("part")
    d = candidates.select(urls.host(F.col("canonical_url")).alias("host"), part, "id", "folded", "source_weight", "published_at")
    d = d.withWatermark("published_at", f"{hours} hours")
    return d.groupBy("host", "part").applyInPandasWithState(
        step, "host string, id string, folded string, source_weight int", "kept string", "append", GroupStateTimeout.EventTimeTimeout
    )


def _place(sort: str) -> tuple[list[int], list[str]]:
    both = json.loads(sort)
    return both["n"], both["t"]


class _Groups(StatefulProcessor):
    """Groups of one host: which group an address or a title belongs to, and each group's preferred row.

    A group is a number; where groups merge, one points to the other. Rows come as
    (canonical_url, folded, sort, row): ``sort`` is the place in the order of preference as JSON, ``row`` all columns as JSON.
    """

    def __init__(self, ttl_ms: int | None):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        def of(*fields: tuple[str, T.DataType]) -> T.StructType:
            return T.StructType([T.StructField(n, t) for n, t in fields])

        number, named = of(("g", T.LongType())), of(("name", T.StringType()))
        self.addresses = handle.getMapState("addresses", named, number, self.ttl)
        self.titles = handle.getMapState("titles", named, number, self.ttl)
        self.groups = handle.getMapState("groups", number, of(("parent", T.LongType()), ("sort", T.StringType()), ("row", T.StringType())), self.ttl)
        self.last = handle.getValueState("last", number, self.ttl)

    def _group(self, held, name: str | None) -> int | None:
        """The group that an address or title belongs to by now."""
        if name is None or not held.containsKey((name,)):
            return None
        g = held.getValue((name,))[0]
        while self.groups.containsKey((g,)):
            parent = self.groups.getValue((g,))[0]
            if parent == g:
                return g
            g = parent
        return None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        said: dict[str, int] = {}
        last = self.last.get()[0] if self.last.exists() else 0
        for pdf in rows:
            for address, title, sort, row in pdf[["canonical_url", "folded", "sort", "row"]].itertuples(index=False):
                title = None if pd.isna(title) else title
                met = sorted({g for g in (self._group(self.addresses, address), self._group(self.titles, title)) if g is not None})
                last += not met
                g = met[0] if met else last
                old = [self.groups.getValue((x,))[1:] for x in met]
                best = min([*old, (sort, row)], key=lambda r: _place(r[0]))
                for x in met[1:]:
                    self.groups.updateValue((x,), (g, None, None))
                self.groups.updateValue((g,), (g, *best))
                self.addresses.updateValue((address,), (g,))
                if title is not None:
                    self.titles.updateValue((title,), (g,))
                for _, gone in old:
                    said[gone] = said.get(gone, 0) - 1
                said[best[1]] = said.get(best[1], 0) + 1
        self.last.update((last,))
        changes = [(row, n) for row, n in said.items() if n]
        yield pd.DataFrame(changes, columns=["row", "change"]).astype({"row": "object", "change": "int64"})

    def close(self) -> None:
        pass


def exact_changes(candidates: DataFrame, folded, ttl_hours: int | None = None) -> DataFrame:
    """Changes to the winners of the first phase: all columns, and ``change``, 1 for a new winner and -1 for one taken back.

    Equal rows are one. Of all batches together, whatever their order, the rows whose changes add up to 1 are those that
    ``dedupe.exact_winners`` keeps; ``settled_changes`` adds them up. Addresses and titles that are quiet for ``ttl_hours`` are
    forgotten; a stream with that setting goes on with empty batches until it is stopped. All rows of a host are one task's, read from its state store one by one; nothing of a host is held in memory.
    """
    columns = candidates.columns
    key = F.to_json(preference_key())
    rows = candidates.select(
        F.coalesce(urls.host(F.col("canonical_url")), F.lit("")).alias("host"), "canonical_url", folded.alias("folded"), key.alias("sort"),
        F.to_json(F.struct(*columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}).alias("row"),
    )
    ttl = None if ttl_hours is None else ttl_hours * 3_600_000
    found = rows.groupBy("host").transformWithStateInPandas(_Groups(ttl), "row string, change long", "Append", "ProcessingTime" if ttl else "None")
    parsed = F.from_json("row", candidates.schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    return found.select(parsed.alias("r"), "change").select(*[F.col("r")[c].alias(c) for c in columns], "change")


def settled_changes(changes: DataFrame) -> DataFrame:
    """The winners that stand after all changes."""
    columns = [c for c in changes.columns if c != "change"]
    return changes.groupBy(*columns).agg(F.sum("change").alias("change")).where("change > 0").drop("change")


def funnel_to(table: str):
    """A ``foreachBatch`` function that stores each batch's counts per source; a batch that is replayed replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("source_id").agg(F.count("*").alias("new_count"), F.max("published_at").alias("latest_published_at"))
        counts.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return write


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per type in tumbling windows; rows later than the watermark are dropped. Works on streams and tables."""
    d = events.withWatermark("ts", late) if events.isStreaming else events
    return d.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
