"""An assessment that is kept up to date as scans come in.

The states that fold() merges are kept by machine, so a machine's newer scan
replaces its part, and only items that a replaced or a new part touches are
folded again.  Links within machines are kept by machine too.  Contents that
enter or leave the component stores change what others' files are; machines
that have such files are taken through again with those that were scanned.

Tables are layers: what an update adds, and the keys that it takes from the
layers below.  An update writes rows of what has changed and nothing else;
compact() puts the layers into one, save() keeps them for later applications.
The load_idx of a scan is its place in the
order of loading and stays as it is; the result is that of assess() over all
scans that were ever given.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import counted, materialize
from ..versions import Versions
from . import assessment
from .assessment import Assessment


@dataclass(frozen=True)
class Layer:
    """Rows, the keys whose rows in the layers below they replace, and where both are kept (for good, once saved)."""

    rows: DataFrame
    gone: DataFrame | None = None
    place: str | None = None

    def saved(self, folder: str) -> Layer:
        if self.place:
            return self
        place = f"{folder}/layers/{uuid.uuid4().hex}"
        self.rows.write.parquet(f"{place}/rows")
        if self.gone is not None:
            self.gone.write.parquet(f"{place}/gone")
        return Layer.load(self.rows.sparkSession, place, self.gone is not None)

    @staticmethod
    def load(spark: SparkSession, place: str, gone: bool) -> Layer:
        return Layer(spark.read.parquet(f"{place}/rows"), spark.read.parquet(f"{place}/gone") if gone else None, place)


@dataclass(frozen=True)
class Layers:
    """Rows by one key."""

    key: str
    layers: tuple[Layer, ...] = ()

    def table(self) -> DataFrame | None:
        out = None
        for x in self.layers:
            out = x.rows if out is None else (out if x.gone is None else out.join(x.gone, self.key, "left_anti")).unionByName(x.rows)
        return out

    def over(self, rows: DataFrame, gone: DataFrame | None) -> Layers:
        return Layers(self.key, (*self.layers, Layer(rows, gone)))

    def compact(self, name: str) -> Layers:
        own = self.table()
        return self if own is None else Layers(self.key, (Layer(materialize(own, name)),))


def _by_machine() -> Layers:
    return Layers("load_idx")


TABLES = ("scans", "occurrences", "stored", "parts", "links", "drafts")


@dataclass(frozen=True)
class Upkeep:
    """What is known of the newest scan of each machine; all tables are written."""

    scans: Layers = field(default_factory=_by_machine)
    aside: tuple[Layer, ...] = ()
    occurrences: Layers = field(default_factory=_by_machine)
    stored: Layers = field(default_factory=_by_machine)
    parts: Layers = field(default_factory=_by_machine)
    links: Layers = field(default_factory=_by_machine)
    drafts: Layers = field(default_factory=lambda: Layers("item_key"))

    def compact(self) -> Upkeep:
        return Upkeep(aside=self.aside, **{n: getattr(self, n).compact(n) for n in TABLES})

    def save(self, folder: str) -> Upkeep:
        """Keeps the state in a folder, as a new version; layers that are there already aren't written again.

        Conflict if another application has saved a state meanwhile.
        """
        spark = self.scans.layers[0].rows.sparkSession
        versions = Versions(spark, folder)
        number = versions.latest() + 1
        kept = {n: Layers(getattr(self, n).key, tuple(x.saved(versions.folder) for x in getattr(self, n).layers)) for n in TABLES}
        aside = tuple(x.saved(versions.folder) for x in self.aside)
        rows = [(n, k, x.place, x.gone is not None) for n, own in (*((n, kept[n].layers) for n in TABLES), ("aside", aside)) for k, x in enumerate(own)]
        versions.publish(spark.createDataFrame(rows, "name string, at int, place string, gone boolean").coalesce(1), number)
        return Upkeep(aside=aside, **kept)

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Upkeep:
        """The last state that save() has kept in a folder; an empty one if there is none."""
        versions = Versions(spark, folder)
        names = versions.names()
        if not names:
            return Upkeep()
        rows = spark.read.parquet(f"{versions.folder}/{names[-1][1]}").orderBy("name", "at").collect()  # a row a layer
        own = {n: tuple(Layer.load(spark, r.place, r.gone) for r in rows if r.name == n) for n in (*TABLES, "aside")}
        return Upkeep(aside=own.pop("aside"), **{n: Layers("item_key" if n == "drafts" else "load_idx", x) for n, x in own.items()})

    def update(self, scans: DataFrame, findings: DataFrame) -> Upkeep:
        """With further scans and their findings; their load_idx are new."""
        first = not self.scans.layers
        known = self.scans.table()
        chosen, aside = assessment.newest_scans(scans if first else known.unionByName(scans.select(*known.columns)))
        chosen, aside = materialize(chosen, "chosen"), Layer(materialize(aside, "aside"))
        new = chosen if first else chosen.join(known.select("load_idx"), "load_idx", "left_anti")
        gone = None if first else materialize(known.select("load_idx").join(chosen.select("load_idx"), "load_idx", "left_anti"), "gone")
        fresh = materialize(findings.join(new.select("load_idx"), "load_idx", "left_semi"), "fresh")
        new_stored = materialize(assessment.stored(fresh).distinct(), "stored")
        stores = self.stored.over(new_stored, gone)
        contents = stores.table().select("sha256").distinct()
        redo, again = fresh, None
        if not first:
            # contents that have entered or left the stores: their files' machines are taken through again
            change = self.stored.table().select("sha256", F.lit(1).alias("was"), F.lit(0).alias("is")).union(contents.select("sha256", F.lit(0), F.lit(1)))
            change = change.groupBy("sha256").agg(F.max("was").alias("was"), F.max("is").alias("is")).where("was <> is").select("sha256")
            kept = self.occurrences.table().join(gone, "load_idx", "left_anti")
            again = materialize(kept.where("loc_kind = 'file'").join(change, "sha256", "left_semi").select("load_idx").distinct(), "again")
            redo = fresh.unionByName(kept.join(again, "load_idx", "left_semi").select(*fresh.columns))
            gone = materialize(gone.union(again), "gone")
        own = materialize(assessment.occurrences(redo, contents), "occurrences")
        new_parts = materialize(assessment.by_machine(own), "parts")
        occ, parts = self.occurrences.over(own, gone), self.parts.over(new_parts, gone)

        if first:
            drafts = self.drafts.over(materialize(assessment.fold(new_parts), "drafts"), None)
            links = self.links.over(materialize(assessment.local_links(own, drafts.table()), "links"), None)
            return Upkeep(Layers("load_idx", (Layer(chosen),)), (aside,), occ, stores, parts, links, drafts)

        touched = new_parts.select("item_key").union(self.parts.table().join(gone, "load_idx", "left_semi").select("item_key"))
        touched = materialize(touched.distinct(), "touched")
        folded = materialize(assessment.fold(parts.table().join(touched, "item_key", "left_semi")), "drafts")
        drafts = self.drafts.over(folded, touched)
        # items that have become or ceased to be a script or a starter change the links of all machines that have them
        flags = F.struct(assessment.is_script().alias("script"), assessment.is_starter().alias("starter"))
        was = self.drafts.table().join(touched, "item_key", "left_semi").select("item_key", flags.alias("was"))
        other = was.join(folded.select("item_key", flags.alias("now")), "item_key").where("was <> now").select("item_key")
        relinked = occ.table().join(other, "item_key", "left_semi").select("load_idx").union(own.select("load_idx"))
        relinked = materialize(relinked.union(new.select("load_idx")).distinct(), "relinked")
        some = occ.table().join(relinked, "load_idx", "left_semi")
        links = self.links.over(materialize(assessment.local_links(some, drafts.table()), "links"), materialize(gone.union(relinked).distinct(), "unlinked"))
        return Upkeep(Layers("load_idx", (Layer(chosen),)), (*self.aside, aside), occ, stores, parts, links, drafts)

    def assess(self, rules: DataFrame | None = None) -> Assessment:
        """Ranks, numbers and effort over all items as they are now."""
        if not self.scans.layers:
            raise ValueError("no scans were given")
        aside = self.aside[0].rows
        for x in self.aside[1:]:
            aside = aside.union(x.rows)
        occ = self.occurrences.table()
        draft, rows = counted(self.drafts.table(), "drafts")
        edges = self.links.table().select("src", "dst").union(assessment.shared_links(occ, draft)).distinct()
        return assessment.ranked(self.scans.table(), aside, occ, draft, rows, materialize(edges, "edges"), rules)
