"""From the findings of many machines to one ranked list of items.

`scans`: load_idx long (order of loading), file, scan_id, hostname, domain,
machine_id, started_at, finished_at.
`findings`: load_idx, pos long (place in its scan), finding_id, rule, kind,
classification, status, reason, activation, loc_kind, loc_path, loc_item,
target, file_size long, sha256.

Every step is a join or an aggregate keyed by machine or item.  What stands for
an item is found with min and max over structs, which combine in each task
before rows move, so an item that every machine reports needs no large group in
one place; lists of occurrences are never built.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import paths
from ..runtime import Descending, counted, materialize, numbered
from ..sources import catalog


def rank(activation) -> Column:
    """How readily something runs: 6 automatic to 1 dormant; unknown values like manual."""
    a = F.col(activation) if isinstance(activation, str) else activation
    out = F.lit(catalog.UNKNOWN_ACTIVATION_RANK)
    for name, value in catalog.ACTIVATION_RANK.items():
        out = F.when(a == name, F.lit(value)).otherwise(out)
    return out


def machine_key() -> list[Column]:
    return [F.lower("hostname"), F.lower(F.coalesce("domain", F.lit(""))), F.lower(F.coalesce("machine_id", F.lit("")))]


def newest_scans(scans: DataFrame, machine_limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The newest scan of each machine (the first loaded of equally new ones), and what is set aside, with why.

    Beyond machine_limit, in load order, machines are set aside too.
    """
    names = ("_k1", "_k2", "_k3")
    keyed = scans.withColumns(dict(zip(names, machine_key(), strict=True)))
    newest = keyed.groupBy(*names).agg(F.max(F.struct(F.col("started_at"), (-F.col("load_idx")).alias("back"))).alias("top"))
    winners = newest.select((-F.col("top.back")).alias("load_idx"))
    inside = winners if machine_limit is None else winners.orderBy("load_idx").limit(machine_limit)
    # all scans meet the few that stay once; why others don't matters to what is set aside only
    chosen = scans.join(inside, "load_idx", "left_semi")
    flagged = scans.join(winners.withColumn("_newest", F.lit(True)), "load_idx", "left").join(inside.withColumn("_inside", F.lit(True)), "load_idx", "left")
    why = F.when(F.col("_newest").isNull(), "superseded").otherwise("machineLimit")
    aside = flagged.where("_inside is null").select("file", "hostname", "started_at", why.alias("why"))
    return chosen, aside


def stored(findings: DataFrame) -> DataFrame:
    """(load_idx, sha256): contents that lie in a component store."""
    likely = F.lower("loc_path").contains("winsxs") & (F.col("loc_kind") == "file") & F.col("sha256").isNotNull()  # spares most paths the whole rule
    return findings.where(likely).where(paths.in_component_store(paths.normalize("loc_path"))).select("load_idx", "sha256")


def occurrences(findings: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """Findings with their normalised path and target, origin, and the key of the item that they belong to.

    A file whose content lies in a component store on any machine is the
    operating system's own wherever it is; store (sha256) has these contents,
    usually those of the findings themselves.
    """
    f = findings.withColumns({"path": paths.normalize("loc_path"), "n_target": paths.normalize("target"), "is_file": F.col("loc_kind") == "file"})
    store = (stored(findings) if store is None else store).select(F.col("sha256").alias("_store")).distinct()
    f = f.join(store, f["sha256"] == store["_store"], "left")
    f = f.withColumn("windows", F.col("is_file") & (F.col("_store").isNotNull() | paths.is_windows_location("path")))
    windows = F.col("windows")
    shared = F.col("is_file") & paths.is_network("path")
    local = ~windows & ~shared
    blank = F.lit("")
    f = f.withColumns(
        {
            "_place": F.when(windows, paths.file_name("path")).otherwise(F.col("path")),
            "_item": F.when(windows, blank).otherwise(F.lower(F.coalesce("loc_item", blank))),
            "_local": F.when(local, F.concat_ws("\x1f", F.lit("l"), "loc_kind", F.coalesce("sha256", blank), F.coalesce("n_target", blank))).when(windows, "w").otherwise("n"),
        }
    )
    # lengths keep the parts apart whatever they contain
    key = F.concat_ws("\x1f", "rule", "status", F.coalesce("reason", blank), F.length("_place").cast("string"), "_place", F.length("_item").cast("string"), "_item", "_local")
    return f.withColumns({"origin": F.when(windows, "windows").otherwise("own"), "item_key": F.unhex(F.md5(key)), "act_rank": rank("activation")}).drop("_store", "_place", "_item", "_local", "windows", "is_file")


def by_machine(occ: DataFrame) -> DataFrame:
    """What each machine adds to each item: states that fold() merges."""
    first = F.struct("load_idx", "pos", "kind", "loc_kind", "status")
    shown = F.struct(
        "load_idx", "loc_path", "loc_item", "pos", "finding_id", "rule", "kind", "classification", "status", "reason", "target", "file_size", "sha256"
    )
    insertion = F.struct("act_rank", "load_idx", "pos", "activation")
    display = F.struct("act_rank", "load_idx", "loc_path", "loc_item", "pos", "activation")
    return occ.groupBy("item_key", "load_idx").agg(
        F.min(first).alias("first"), F.min(shown).alias("shown"), F.max(insertion).alias("strongest"), F.max(display).alias("displayed"), F.max("origin").alias("origin"), F.count("*").alias("n")
    )


def drafts(occ: DataFrame) -> DataFrame:
    """One row an item: what was seen first, what represents it, how it runs, how many machines have it."""
    return fold(by_machine(occ))


def fold(parts: DataFrame) -> DataFrame:
    """The items of by_machine()'s states."""
    item = parts.groupBy("item_key").agg(
        F.min("first").alias("first"),
        F.min("shown").alias("shown"),
        F.max("strongest").alias("strongest"),
        F.max("displayed").alias("displayed"),
        F.max("origin").alias("origin"),
        F.sum("n").alias("occurrences"),
        F.count("*").alias("machines"),
    )
    s = F.col("shown")
    return item.select(
        "item_key", "origin", "occurrences", "machines",
        F.struct(F.col("first.load_idx"), F.col("first.pos")).alias("first_seen"),
        F.col("first.kind").alias("seen_kind"), F.col("first.loc_kind").alias("seen_loc_kind"), F.col("first.status").alias("seen_status"),
        F.col("strongest.activation").alias("own_activation"), F.col("displayed.activation").alias("reported_activation"),
        s["load_idx"].alias("machine"), s["loc_path"].alias("loc_path"), s["loc_item"].alias("loc_item"), s["finding_id"].alias("finding_id"), s["rule"].alias("rule"), s["kind"].alias("kind"),
        F.when(s["classification"] == "breaks", "breaks").otherwise("review").alias("classification"), s["status"].alias("status"), s["reason"].alias("reason"),
        s["target"].alias("target"), s["file_size"].alias("file_size"), s["sha256"].alias("sha256"),
    )


def is_script() -> Column:
    """Items that others can start."""
    return F.col("seen_kind").isin("scriptFile", "scriptInvocation") & (F.col("seen_loc_kind") == "file") & (F.col("seen_status") == "detected")


def is_starter() -> Column:
    return ~F.col("seen_kind").isin("scriptFile", "hardcodedCredential")


def _ends(occ: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scripts (dst, load_idx, path) and starters (src, load_idx, n_target).

    Occurrences meet only those items that can be one or the other, and only
    those that name a target can start something.
    """
    files = occ.where("loc_kind = 'file'").select("item_key", "load_idx", "path")
    scripts = files.join(items.where(is_script()).select("item_key"), "item_key", "left_semi").select(F.col("item_key").alias("dst"), "load_idx", "path").distinct()
    named = occ.where("n_target is not null").select("item_key", "load_idx", "n_target")
    starters = named.join(items.where(is_starter()).select("item_key"), "item_key", "left_semi").select(F.col("item_key").alias("src"), "load_idx", "n_target").distinct()
    return scripts, starters


def _shared(scripts: DataFrame, starters: DataFrame) -> DataFrame:
    targets = starters.where(paths.is_network("n_target")).select("src", F.col("n_target").alias("path")).distinct()
    return targets.join(scripts.where(paths.is_network("path")).select("dst", "path").distinct(), "path").where("src <> dst").select("src", "dst")


def _local(scripts: DataFrame, starters: DataFrame) -> DataFrame:
    local = starters.where(~paths.is_network("n_target"))
    absolute = local.where(paths.is_absolute("n_target")).withColumnRenamed("n_target", "path").join(scripts.where(~paths.is_network("path")), ["load_idx", "path"])
    names = scripts.select("load_idx", paths.file_name("path").alias("name"), "dst").groupBy("load_idx", "name").agg(F.min("dst").alias("dst"), F.max("dst").alias("other")).where("dst = other")
    relative = local.where(~paths.is_absolute("n_target")).select("src", "load_idx", paths.file_name("n_target").alias("name")).join(names, ["load_idx", "name"])
    return absolute.select("load_idx", "src", "dst").union(relative.select("load_idx", "src", "dst")).where("src <> dst")


def local_links(occ: DataFrame, items: DataFrame) -> DataFrame:
    """(load_idx, src, dst): which items start which scripts on a machine.

    An absolute target is the path on the same machine; any other is a file
    name that only one script of the machine has.
    """
    return _local(*_ends(occ, items)).distinct()


def shared_links(occ: DataFrame, items: DataFrame) -> DataFrame:
    """(src, dst): a target on the network is that path on any machine."""
    share = occ.where(paths.is_network("path") | paths.is_network("n_target"))
    return _shared(*_ends(share, items)).distinct()


def links(occ: DataFrame, items: DataFrame) -> DataFrame:
    """(src, dst): which items start which scripts, on their machine or through the network."""
    scripts, starters = _ends(occ, items)
    return _shared(scripts, starters).union(_local(scripts, starters).select("src", "dst")).distinct()


#: Rounds of propagate() after which their tables are merged.
MERGED = 8


def propagate(items: DataFrame, edges: DataFrame) -> DataFrame:
    """items with `activation`: a script runs at least as readily as what starts it, through any chain.

    edges is read once a round, so it should be a written table.  A round offers
    the labels of the items that rose in the one before, and writes those whose
    rank rises by an offer, and nothing else; what an item has risen to is the
    last that was written of it.  A label changes only for a stronger one, so
    an item rises five times at most, and the rounds end.  After every
    MERGED rounds what they have written is put together, so that a round reads
    few tables however long the chains are.
    """
    ends = edges.select(F.col("src").alias("item_key")).union(edges.select(F.col("dst").alias("item_key"))).distinct()
    base, rows = counted(items.join(ends, "item_key", "left_semi").select("item_key", "first_seen", F.col("own_activation").alias("activation"), rank("own_activation").alias("r")), "ends")
    rose, risen, rounds = base, None, 0
    while rows:
        rounds += 1
        label = rose.select(F.col("item_key").alias("src"), F.struct((-F.col("r")).alias("down"), "first_seen", "activation").alias("offer"))
        offers = edges.join(label, "src").groupBy(F.col("dst").alias("item_key")).agg(F.min("offer").alias("offer"))
        now = offers.join(base.select("item_key", "first_seen", "r"), "item_key")
        had = F.col("r")
        if risen is not None:
            now = now.join(risen.groupBy("item_key").agg(F.max("r").alias("_risen")), "item_key", "left")
            had = F.greatest("r", F.coalesce("_risen", "r"))
        up = now.where(-F.col("offer.down") > had).select("item_key", "first_seen", F.col("offer.activation").alias("activation"), (-F.col("offer.down")).alias("r"))
        rose, rows = counted(up, "risen")
        risen = rose if risen is None else risen.union(rose)
        if rounds % MERGED == 0:
            risen = materialize(risen.groupBy("item_key").agg(F.max_by(F.struct("first_seen", "activation", "r"), "r").alias("x")).select("item_key", "x.*"), "merged")
    if risen is None:
        return items.withColumn("activation", F.col("own_activation"))
    last = risen.groupBy("item_key").agg(F.max_by("activation", "r").alias("_through"))
    return items.join(last, "item_key", "left").withColumn("activation", F.coalesce("_through", "own_activation")).drop("_through")


def risk() -> Column:
    r, breaks = rank("activation"), F.col("classification") == "breaks"
    return F.when(F.col("origin") == "windows", "info").when(breaks & (r >= 5), "high").when((breaks & (r >= 2)) | (r >= 5), "medium").otherwise("low")


def priority_order() -> list:
    """Own before the system's, by risk, readiness, certainty and spread, then by rule and place."""
    return [
        F.when(F.col("origin") == "own", 0).otherwise(1),
        F.when(F.col("risk") == "high", 0).when(F.col("risk") == "medium", 1).when(F.col("risk") == "low", 2).otherwise(3),
        Descending(rank("activation")),
        F.col("classification") != "breaks",
        F.col("status") != "detected",
        Descending(F.col("machines")),
        F.col("rule"),
        F.lower("loc_path"),
        F.lower(F.coalesce("loc_item", F.lit(""))),
        F.col("first_seen"),
    ]


def size_factor(size) -> Column:
    s = F.col(size) if isinstance(size, str) else size
    return F.when(s.isNull() | (s <= 8 * 1024), 1).when(s <= 32 * 1024, 2).when(s <= 128 * 1024, 4).otherwise(8)


def same_content(items: DataFrame) -> DataFrame:
    """items with `same_as`: the number of the first item with the same rule, module and content, where it is another."""
    eligible = (F.col("origin") == "own") & (F.col("status") == "detected") & F.col("sha256").isNotNull()
    # items without content to compare are each by themselves
    alone = F.when(~eligible, F.col("number"))
    alike = W.partitionBy("rule", F.lower(F.coalesce("loc_item", F.lit(""))), "sha256", alone)
    first = F.min("number").over(alike)
    return items.withColumn("same_as", F.when(eligible & (first < F.col("number")), first))


def effort(items: DataFrame, occ: DataFrame, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """items of same_content() with effort_kind (hours, sameAs, windows), min_hours, max_hours, size_factor, typical_script.

    An entry that starts scripts which no scan has found carries a typical
    script's effort, unless an earlier entry carries one for all of them.
    """
    low, high = catalog.UNKNOWN_EFFORT
    ruled = items.join(F.broadcast(rules.select("rule", "min_hours", "max_hours", "basis", "hint")), "rule", "left")
    typical = next(((r[3], r[4]) for r in catalog.RULES if r[0] == "VBS-101"), (1.0, 4.0))
    own = (F.col("origin") == "own") & F.col("same_as").isNull()
    starters = edges.select(F.col("src").alias("item_key")).distinct()
    entries = ruled.where(own & (F.col("basis") == "entry") & (F.col("status") == "detected")).join(starters, "item_key", "left_anti").select("item_key", "number")
    missing = occ.where(paths.is_script_file("n_target")).select("item_key", F.when(paths.is_absolute("n_target"), F.col("n_target")).otherwise(paths.file_name("n_target")).alias("script")).distinct().join(entries, "item_key")
    first = missing.groupBy("script").agg(F.min("number").alias("number"))
    carries = first.select("number").distinct().withColumn("_typical", F.lit(True))
    out = ruled.join(carries, "number", "left").withColumn("typical_script", F.coalesce("_typical", F.lit(False)))
    factor = F.when(F.col("basis") == "scriptSize", size_factor("file_size")).otherwise(1)
    extra = lambda x: F.when(F.col("typical_script"), F.lit(x)).otherwise(F.lit(0.0))
    return out.withColumns(
        {
            "effort_kind": F.when(F.col("origin") != "own", "windows").when(F.col("same_as").isNotNull(), "sameAs").otherwise("hours"),
            "size_factor": F.when(own, factor),
            "min_hours": F.when(own, F.coalesce("min_hours", F.lit(low)) * factor + extra(typical[0])),
            "max_hours": F.when(own, F.coalesce("max_hours", F.lit(high)) * factor + extra(typical[1])),
        }
    ).drop("_typical", "basis")


@dataclass
class Assessment:
    """Tables of one assessment.  Items and links are keyed by number."""

    machines: DataFrame
    set_aside: DataFrame
    items: DataFrame
    occurrences: DataFrame
    links: DataFrame

    @property
    def own(self) -> DataFrame:
        return self.items.where(F.col("origin") == "own")

    @property
    def windows(self) -> DataFrame:
        return self.items.where(F.col("origin") == "windows")

    def item(self, number: int) -> DataFrame:
        return self.items.where(F.col("number") == number)


def assess(scans: DataFrame, findings: DataFrame, rules: DataFrame | None = None, machine_limit: int | None = None) -> Assessment:
    """Newest scans, items, links, activation, risk, numbers and effort."""
    chosen, aside = newest_scans(scans, machine_limit)
    # both are read several times, and what they come from is many times larger
    chosen = materialize(chosen, "chosen")
    found = materialize(findings.join(chosen.select("load_idx"), "load_idx", "left_semi"), "found")
    occ = materialize(occurrences(found), "occurrences")
    draft, rows = counted(drafts(occ), "drafts")
    return ranked(chosen, aside, occ, draft, rows, materialize(links(occ, draft), "edges"), rules)


def ranked(chosen: DataFrame, aside: DataFrame, occ: DataFrame, draft: DataFrame, rows: int, edges: DataFrame, rules: DataFrame | None = None) -> Assessment:
    """What follows from items and links, which are written tables: activation, risk, numbers and effort."""
    rules = catalog.rules(chosen.sparkSession) if rules is None else rules
    counts = occ.groupBy("load_idx").agg(F.count_if(F.col("status") != "notCheckable").alias("detected"), F.count_if(F.col("status") == "notCheckable").alias("not_checkable"))
    machines = chosen.join(counts, "load_idx", "left").fillna(0, ["detected", "not_checkable"])
    items = numbered(propagate(draft, edges).withColumn("risk", risk()), priority_order(), rows=rows)
    items = materialize(same_content(items), "numbered")
    items = materialize(effort(items, occ, edges, rules), "items")
    number = items.select("item_key", "number")
    src, dst = (number.select(F.col("item_key").alias(k), F.col("number").alias(n)) for k, n in (("src", "starter"), ("dst", "script")))
    linked = edges.join(src, "src").join(dst, "dst").select("starter", "script")
    return Assessment(machines, aside, items, occ.join(number, "item_key"), linked)
