"""Which documents hold which nested keys: a stored index in the other direction, kept up by the main table's own changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.incremental import images
from ..plans.lineage import Analyser, keys_of
from ..plans.mapping import Field, Mapping
from ..sources.snapshots import Snapshots, stored


class OwnerIndex:
    """For each nested field of a mapping that is not tied by the primary key: (nested key, document id), in buckets by the key.

    It holds the pairs of the main table as far as changes were applied. With it, finding the documents of changed nested keys
    reads the buckets of those keys and not the main table."""

    def __init__(self, spark: SparkSession, mapping: Mapping, root: str, analyser: Analyser | None = None, **how):
        self.spark, self.mapping, self.root, self.how = spark, mapping, root, how
        whole = (analyser or Analyser(spark)).query(mapping.sql)
        self.table, self.pk = whole.main.table, whole.item(mapping.pk).columns[0][1]
        self.fields = [f for f in mapping.nested if [v.lower() for _, v in keys_of(f)] != [self.pk.lower()]]

    def store(self, f: Field) -> Snapshots:
        return Snapshots(self.spark, self.root, f"{self.mapping.index}-owners-{f.name}", by="_key", **self.how)

    @staticmethod
    def _key(columns: list[Column]) -> Column:
        """A nested key as one text; parts are escaped, so different keys differ. Null if a part is: it ties nothing."""
        return F.concat_ws("|", *[F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\p")) for c in columns])

    def _pairs(self, rows: DataFrame, f: Field) -> DataFrame:
        tied = [F.col(f"`{v}`") for _, v in keys_of(f)]
        id_ = F.col(f"`{self.pk}`").cast("string")
        key = self._key(tied)
        filled = rows.filter(" and ".join(f"`{v}` is not null" for _, v in keys_of(f)) + f" and `{self.pk}` is not null")
        own = {c.lower(): F.col(f"`{c}`") for c in [self.pk, *(v for _, v in keys_of(f))]}
        filled = filled.select(*own.values()).distinct()  # before the texts are made, which are longer
        return filled.select(F.concat_ws("\u0000", key, id_).alias("_id"), key.alias("_key"), id_.alias("document"))

    def load(self) -> None:
        """The pairs of the main table as it is, for each field that has none yet."""
        for f in self.fields:
            store = self.store(f)
            if store.version() is None:
                store.write(self._pairs(self.spark.table(self.table), f))

    def apply(self, changes: DataFrame, stream: str, batch: int) -> None:
        """The pairs after a batch of changes; a batch that is applied already changes nothing.

        Pairs of rows' last images come in, and pairs that only before images had go. An update that left the keys alone writes nothing."""
        own = changes.filter(F.lower("table") == self.table.lower())
        due = [f for f in self.fields if (store := self.store(f)).version() is not None and store.applied(stream) < batch]
        if not due or own.isEmpty():
            return
        for f in due:
            store = self.store(f)
            wanted = [x for x in self.spark.table(self.table).schema.fields if x.name.lower() in {self.pk.lower(), *(v.lower() for _, v in keys_of(f))}]
            schema, tied = T.StructType(wanted), [v for _, v in keys_of(f)]
            altered = stored(self._altered(own, [self.pk, *tied]))
            rows = self._events(own, [x.name for x in wanted]).join(altered, "row", "left_semi")  # of these rows only, all that happened
            new = self._pairs(images(self._last(rows), schema), f)
            old = self._pairs(images(rows.select("before", F.lit(None).cast("map<string,string>").alias("after")), schema), f)
            store.update(new, old.join(new.select("_id"), "_id", "left_anti"), {stream: batch})
            store.compact()
            store.prune()

    @staticmethod
    def _value(image: Column, column: str) -> Column:
        return F.element_at(F.transform_keys(image, lambda k, _: F.lower(k)), column.lower())

    def _altered(self, own: DataFrame, columns: list[str]) -> DataFrame:
        """The primary keys (row) of rows that came, went or changed one of columns."""
        before, after = F.col("before"), F.col("after")
        differs = reduce(lambda a, b: a | b, [~self._value(before, c).eqNullSafe(self._value(after, c)) for c in columns])
        keys = F.array(self._value(before, self.pk), self._value(after, self.pk))
        return own.filter((F.col("op") != "UPDATE") | differs).select(F.explode(keys).alias("row")).filter("row is not null").distinct()

    def _events(self, own: DataFrame, columns: list[str]) -> DataFrame:
        """(row, seq, step, before, after): what each change did to a row of its primary key, with the given columns of the images only. An
        update that moves a row to another key takes it from the old one first, and its before image is that one's."""
        wanted = lambda image: F.map_filter(image, lambda k, _: F.lower(k).isin(*[c.lower() for c in columns]))
        before, after = F.col("before"), F.col("after")
        old, new = self._value(before, self.pk), self._value(after, self.pk)
        none, moved = F.lit(None).cast("map<string,string>"), ~old.eqNullSafe(new)
        event = lambda row, step, b, a: F.struct(row.alias("row"), F.lit(step).alias("step"), b.alias("before"), a.alias("after"))
        each = F.array_compact(F.array(
            F.when(before.isNotNull() & moved, event(old, 0, before, none)),
            F.when(after.isNotNull(), event(new, 1, F.when(~moved, before), after)),
        ))
        small = own.select("seq", wanted(before).alias("before"), wanted(after).alias("after"))
        return small.select("seq", F.explode(each).alias("e")).select("e.row", "seq", "e.step", "e.before", "e.after")

    @staticmethod
    def _last(events: DataFrame) -> DataFrame:
        """(row, before, after) with each row's last image in after; a row that is gone, or moved to another key, has none."""
        none = F.lit(None).cast("map<string,string>")
        last = events.groupBy("row").agg(F.max_by("after", F.struct("seq", "step")).alias("after"))
        return last.filter("after is not null").select("row", none.alias("before"), "after")

    def owners(self, f: Field, keys: DataFrame) -> DataFrame:
        """The ids of the documents that hold nested keys (_k0, ...)."""
        wanted = stored(keys.select(self._key([F.col(f"_k{n}") for n in range(len(keys_of(f)))]).alias("_key")).distinct())
        return self.store(f).read(only=wanted).join(wanted, "_key", "left_semi").select(F.col("document").alias("_id"))
