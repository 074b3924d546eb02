"""A catalogue of indices: declared types, aliases that move in one step, copies into a new index while the old one is written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.view import typed
from ..plans.index_types import check_strict, target_types
from .snapshots import Commits, Snapshots, stored

#: How documents become those of a new index.
Change = Callable[[DataFrame], DataFrame]


class IndexConflict(RuntimeError):
    """Another writer changed the catalogue in between."""


class Indices(Commits):
    """The indices under root (each a Snapshots folder) and their aliases, in one numbered state.

    A state is small (a line for each index and alias) and appears in one step, so readers that resolve an alias see the
    old index or the new one, never none or both. A writer whose state was overtaken by another's fails with IndexConflict."""

    def __init__(self, spark: SparkSession, root: str, **snapshots):
        self.root, self.snapshots = root.rstrip("/"), snapshots
        super().__init__(spark, f"{self.root}/_indices")

    def state(self) -> dict:
        version = self.version()
        return {"meta": {}, "aliases": {}} if version is None else self._commit(version)

    def _change(self, edit: Callable[[dict], None]) -> None:
        version = self.version()
        state = {"meta": {}, "aliases": {}} if version is None else self._commit(version)
        edit(state)
        try:
            self._publish(0 if version is None else version + 1, state)
        except RuntimeError as error:
            raise IndexConflict(str(error)) from error

    def resolve(self, name: str) -> str:
        """The index that an alias stands for; any other name is an index's own."""
        return self.state()["aliases"].get(name, name)

    def open(self, name: str) -> Snapshots:
        return Snapshots(self.spark, self.root, self.resolve(name), **self.snapshots)

    def read(self, name: str) -> DataFrame | None:
        return self.open(name).read()

    def create(self, index: str, meta: str | None = None, *, like: str | None = None) -> None:
        """Declares an index: its types as a mapping document (see plans.index_types), or those of another index or alias.
        One that is there already stays if it is declared alike, and is an error if it is not."""
        def edit(state: dict) -> None:
            own = state["meta"].get(state["aliases"].get(like, like)) if like else meta
            if index in state["aliases"] or state["meta"].get(index, own) != own:
                raise ValueError(f"{index} is there already, as something else")
            state["meta"][index] = own

        self._change(edit)

    def target(self, name: str) -> dict:
        """The declared types of an index; empty if it has none, where documents stay as they are."""
        meta = self.state()["meta"].get(self.resolve(name))
        return target_types(meta, name) if meta else {}

    def write(self, name: str, docs: DataFrame, marks: dict[str, int] | None = None) -> int:
        """Documents as the index's next version, in its types; fields that its declaration lacks are an error."""
        return self.open(name).write(self._typed(name, docs), marks=marks)

    def _typed(self, name: str, docs: DataFrame) -> DataFrame:
        target = self.target(name)
        return typed(check_strict(docs, target), target) if target else docs

    def point(self, aliases: dict[str, str]) -> None:
        """Moves all these aliases (alias -> index) in one step. An alias may not have the name of an index, nor point to none."""
        def edit(state: dict) -> None:
            for alias, index in aliases.items():
                if alias in state["meta"]:
                    raise ValueError(f"{alias} is an index")
                if index not in state["meta"]:
                    raise LookupError(f"no such index: {index}")
            state["aliases"] |= aliases

        self._change(edit)

    def copy(self, source: str, to: str, change: Change = lambda docs: docs) -> int:
        """Copies an index (or an alias's) into another, declared like it unless it is there, in the types of that one. Returns
        the version of the source that was copied, for catch_up. The batches that it held count as held in the copy. change may
        leave documents out, but keeps the ids of the others."""
        old = self.open(source)
        version = old.version()
        if to not in self.state()["meta"]:
            self.create(to, like=source)
        self.open(to).write(self._typed(to, change(old.read(version))), marks=old.state(version)["marks"])
        return version

    def catch_up(self, source: str, to: str, since: int, change: Change = lambda docs: docs) -> int:
        """Brings a copy, which nothing else writes to yet, to the source's current version, which it returns. Only buckets that
        changed since the version that the copy has are read and written again; documents of the copy that such a bucket no
        longer holds go."""
        old, new = self.open(source), self.open(to)
        version = old.version()
        if version != since:
            docs, inside = old.changed_since(since)
            docs = stored(self._typed(to, change(docs)))
            held = docs.select("_id").hint("merge")  # these may be all ids, which as files look small enough to be sent to everyone
            gone = new.read().select("_id").filter(inside(F.col("_id"))).join(held, "_id", "left_anti")
            new.update(docs, gone, old.state(version)["marks"])
            new.compact()
        return version

    def reindex(self, alias: str, to: str, change: Change = lambda docs: docs) -> None:
        """Copies what an alias stands for into a new index and moves the alias, while the old index is written.

        The copy catches up with what was written meanwhile, each time with less, until it can seal the old index at the
        version that it has: a writer that commits first is caught up with once more, and one that comes later finds
        the seal (Sealed), resolves the alias again and writes to the new index. So no write is lost."""
        source = self.resolve(alias)
        old, since = self.open(source), self.copy(source, to, change)
        while not old.seal(since):
            since = self.catch_up(source, to, since, change)
        self.point({alias: to})

    def replace(self, alias: str, to: str, docs: Callable[[], DataFrame]) -> int:
        """Fills a new index with docs() and moves the alias to it. The old index is sealed before docs is called, so that what
        docs reads is no older than the last write to it; readers have the old one until the alias moves, and writers wait.
        If that fails, the old index is opened again. Returns the new index's version."""
        old = self.open(alias)
        while (version := old.version()) is not None and not old.seal(version):
            pass
        try:
            if to not in self.state()["meta"]:
                self.create(to, like=alias)
            out = self.write(to, docs(), {} if version is None else old.state(version)["marks"])
            self.point({alias: to})
            return out
        except BaseException:
            if version is not None:
                old.seal(version + 1, sealed=False)
            raise

    def drop(self, index: str) -> None:
        """Deletes an index, unless an alias stands for it."""
        def edit(state: dict) -> None:
            if held := [a for a, i in state["aliases"].items() if i == index]:
                raise ValueError(f"{index} is in use as {', '.join(held)}")
            if state["meta"].pop(index, self) is self:
                raise LookupError(f"no such index: {index}")

        self._change(edit)
        Snapshots(self.spark, self.root, index).drop()
