r"""Entries of systems that start programs, as queries over registry and WMI tables.

`registry`: load_idx, hive (HKLM or HKU), view (native or wow32), key (below
the hive, for users behind their SID), name, value (text), offline boolean (of
a user who was not logged on).  Names and keys compare whatever their case.
`wmi`: load_idx, namespace, class, path, properties map<string,string>.
Each query yields command lines for detect.detect_commands().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import detect

# Keys below a hive whose values are commands, and single values of others.
CURRENT = "software\\microsoft\\windows\\currentversion\\"
RUN_KEYS = {
    CURRENT + "run": "run",
    CURRENT + "runonce": "runOnce",
    CURRENT + "runservices": "runServices",
    CURRENT + "runservicesonce": "runServicesOnce",
    CURRENT + "policies\\explorer\\run": "policyRun",
}
WINLOGON = "software\\microsoft\\windows nt\\currentversion\\winlogon"
WINDOWS = "software\\microsoft\\windows nt\\currentversion\\windows"
PROCESSOR = "software\\microsoft\\command processor"
ACTIVE_SETUP = "software\\microsoft\\active setup\\installed components\\"
MACHINE_VALUES = [(WINLOGON, ("userinit", "shell", "taskman", "appsetup"), "winlogon"), (PROCESSOR, ("autorun",), "commandProcessor")]
USER_VALUES = [(WINLOGON, ("shell",), "winlogon"), (WINDOWS, ("load", "run"), "windowsLoad"), (PROCESSOR, ("autorun",), "commandProcessor")]
SERVICES = "system\\currentcontrolset\\services\\"
POLICY = CURRENT + "group policy\\scripts\\"
POLICY_STATE = CURRENT + "group policy\\state\\"
PROGRAM_SERVICE = 0x70

COLUMNS = ["load_idx", "loc_kind", "loc_path", "loc_item", "activation", "line", "folder", "details"]


def _keyed(registry: DataFrame) -> DataFrame:
    """With `sid` of user hives, the key below it, and lower-case forms."""
    user = F.col("hive") == "HKU"
    below = F.when(user & ~F.col("offline"), F.regexp_replace("key", r"^[^\\]*\\", "")).otherwise(F.col("key"))
    return registry.withColumns({"below": below, "low_key": F.lower(below), "low_name": F.lower("name"), "line": F.trim("value")}).where("line <> ''")


def _shown(key: Column) -> Column:
    """A key as it is reported: in the 32-bit view below WOW6432Node."""
    wow = (F.col("view") == "wow32") & F.upper(key).startswith("SOFTWARE\\")
    shown = F.when(wow, F.concat(F.lit("SOFTWARE\\WOW6432Node\\"), F.substr(key, F.lit(10)))).otherwise(key)
    owner = F.when(F.col("hive") == "HKLM", F.lit("HKLM\\")).otherwise(F.concat(F.lit("HKU\\"), F.coalesce("sid", F.regexp_extract("key", r"^([^\\]*)", 1)), F.lit("\\")))
    return F.concat(owner, shown)


def _offline() -> Column:
    return F.when(F.col("offline"), F.create_map(F.lit("offlineHive"), F.lit("true"))).otherwise(F.create_map().cast("map<string,string>"))


def autostart(registry: DataFrame) -> DataFrame:
    """Run keys, and single values, of the machine and of each user."""
    r = _keyed(registry if "sid" in registry.columns else registry.withColumn("sid", F.lit(None).cast("string")))
    machine = F.col("hive") == "HKLM"
    kind = F.lit(None).cast("string")
    for key, name in RUN_KEYS.items():
        kind = F.when(F.col("low_key") == key, F.lit(name)).otherwise(kind)
    kind = F.when(machine & F.col("low_key").rlike("^" + (CURRENT + "runonceex").replace("\\", "\\\\") + r"\\[^\\]+$"), "runOnceEx").otherwise(kind)
    kind = F.when(machine & F.col("low_key").rlike("^" + ACTIVE_SETUP.replace("\\", "\\\\") + r"[^\\]+$") & (F.col("low_name") == "stubpath"), "activeSetup").otherwise(kind)
    for who, values in ((machine, MACHINE_VALUES), (~machine, USER_VALUES)):
        for key, names, label in values:
            native = (F.col("view") == "native") | F.lit(key == PROCESSOR)
            kind = F.when(who & native & (F.col("low_key") == key) & F.col("low_name").isin(*names), label).otherwise(kind)
    found = r.withColumn("type", kind).where("type is not null")
    # a list of programs is read as so many commands, but reported as written
    line = F.when(F.col("low_name") == "userinit", F.replace("line", F.lit(","), F.lit(" & "))).otherwise(F.col("line"))
    details = F.map_concat(F.create_map(F.lit("autostartType"), F.col("type")), _offline())
    return found.select("load_idx", F.lit("registry").alias("loc_kind"), _shown(F.col("below")).alias("loc_path"), F.col("name").alias("loc_item"), F.lit("automatic").alias("activation"), line.alias("line"), details.alias("details"))


def image_path(path: Column) -> Column:
    p = F.trim(path)
    return F.when(p.startswith("\\??\\"), F.substr(p, F.lit(5))).when((F.length(p) > 12) & F.lower(F.substring(p, 1, 12)).eqNullSafe("\\systemroot\\"), F.concat(F.lit("%SystemRoot%\\"), F.substr(p, F.lit(13)))).otherwise(p)


def services(registry: DataFrame) -> DataFrame:
    """Image paths, failure commands and wrapped programs of services that run a program."""
    r = registry.where((F.col("hive") == "HKLM") & (F.col("view") == "native") & F.lower("key").startswith(SERVICES)).withColumns(
        {"service": F.regexp_extract(F.substr("key", F.lit(len(SERVICES) + 1)), r"^([^\\]+)", 1), "rest": F.lower(F.regexp_replace(F.substr("key", F.lit(len(SERVICES) + 1)), r"^[^\\]+\\?", "")), "low_name": F.lower("name")}
    )
    value = lambda rest, name: F.max(F.when((F.col("rest") == rest) & (F.col("low_name") == name), F.col("value")))
    s = r.where(F.col("rest").isin("", "parameters")).groupBy("load_idx", "service").agg(
        value("", "type").alias("type"), value("", "start").alias("start"), value("", "displayname").alias("display"), value("", "imagepath").alias("image"), value("", "failurecommand").alias("failure"),
        value("parameters", "application").alias("application"), value("parameters", "appparameters").alias("parameters"),
        value("parameters", "appdirectory").alias("directory"),
    )
    s = s.where(F.coalesce(F.try_to_number("type", F.lit("9999999999")).cast("long"), F.lit(0)).bitwiseAND(F.lit(PROGRAM_SERVICE)) != 0)
    start = F.col("start")
    activation = F.when(start.isin("0", "1", "2"), "automatic").when(start == "4", "dormant").otherwise("manual")
    start_type = F.when(start.isin("0", "1", "2"), "automatic").when(start == "3", "manual").when(start == "4", "disabled").otherwise("unknown")
    display = F.when(F.col("display").isNotNull() & ~F.col("display").startswith("@"), F.create_map(F.lit("displayName"), F.col("display"))).otherwise(F.create_map().cast("map<string,string>"))
    wrapped = F.when(F.trim("application") != "", F.concat(F.lit('"'), F.regexp_replace(F.trim("application"), '^"+|"+$', ""), F.lit('" '), F.coalesce("parameters", F.lit(""))))
    none = F.lit(None).cast("string")
    lines = F.array(
        F.struct(F.lit("ImagePath").alias("item"), image_path(F.col("image")).alias("line"), none.alias("folder")),
        F.struct(F.lit("FailureCommand").alias("item"), image_path(F.col("failure")).alias("line"), none.alias("folder")),
        F.struct(F.lit("Parameters\\Application").alias("item"), wrapped.alias("line"), F.col("directory").alias("folder")),
    )
    each = s.withColumns({"activation": activation, "details": F.map_concat(F.create_map(F.lit("startType"), start_type), display)}).select("*", F.explode(lines).alias("c")).where("c.line is not null")
    return each.select("load_idx", F.lit("service").alias("loc_kind"), F.col("service").alias("loc_path"), F.col("c.item").alias("loc_item"), "activation", F.col("c.line").alias("line"), F.col("c.folder").alias("folder"), "details")


def full_script_path(script: Column, folder: Column) -> Column:
    """A policy's script name, completed with the policy's folder where it is relative."""
    s = F.regexp_replace(F.trim(script), '^"+|"+$', "")
    absolute = s.rlike(r"^(\\\\|.:.|%|/)")
    return F.when(absolute | (F.coalesce(folder, F.lit("")) == "") | ~s.contains("."), s).otherwise(F.concat(F.regexp_replace(folder, r"\\+$", ""), F.lit("\\"), s))


def logon_scripts(registry: DataFrame) -> DataFrame:
    """Group Policy scripts of machine, accounts and users, each once a machine, and users' logon commands."""
    r = _keyed(registry if "sid" in registry.columns else registry.withColumn("sid", F.lit(None).cast("string"))).where("view = 'native'")
    q = lambda x: x.replace("\\", "\\\\")
    pattern = rf"^(?:{q(POLICY)}|{q(POLICY_STATE)}[^\\]+\\scripts\\)(logon|logoff|startup|shutdown)\\([^\\]+)(?:\\([^\\]+))?$"
    p = r.withColumns({"phase": F.regexp_extract("low_key", pattern, 1), "index": F.regexp_extract("low_key", pattern, 3)}).where("phase <> ''")
    p = p.where(F.col("low_key").startswith(POLICY_STATE) | ((F.col("hive") == "HKLM") & F.col("phase").isin("startup", "shutdown")) | ((F.col("hive") == "HKU") & F.col("phase").isin("logon", "logoff")))
    parent = F.when(F.col("index") == "", F.col("below")).otherwise(F.regexp_replace("below", r"\\[^\\]+$", ""))
    p = p.withColumn("policy", parent)
    owner = ["load_idx", "hive", "key_owner"]
    p = p.withColumn("key_owner", F.when(F.col("hive") == "HKU", F.coalesce("sid", F.regexp_extract("key", r"^([^\\]*)", 1))).otherwise(F.lit("")))
    value = lambda name: F.max(F.when(F.col("low_name") == name, F.col("value")))
    policies = p.where("index = ''").groupBy(*owner, F.lower("policy").alias("policy")).agg(value("filesyspath").alias("folder"), F.coalesce(value("displayname"), value("gponame")).alias("policy_name"))
    scripts = p.where("index <> ''").groupBy(*owner, F.lower("policy").alias("policy"), "below", "phase", "offline", "view").agg(value("script").alias("script"), value("parameters").alias("parameters"), F.first("key").alias("key"), F.first("sid").alias("sid")).where("trim(script) <> ''")
    joined = scripts.join(policies, [*owner, "policy"], "left")
    # the phase as it is written in the key
    phase = F.regexp_extract("below", r"(?i)\\(logon|logoff|startup|shutdown)\\[^\\]+\\[^\\]+$", 1)
    full = full_script_path(F.col("script"), F.concat(F.col("folder"), F.lit("\\Scripts\\"), phase))
    named = joined.withColumns({"full": full, "parameters": F.coalesce("parameters", F.lit(""))})
    # the machine's own policies come first, then accounts' and users', by key
    first = F.row_number().over(W.partitionBy("load_idx", "phase", F.lower("full"), F.lower("parameters")).orderBy(F.col("hive") == "HKU", F.lower("below").startswith(POLICY_STATE), "offline", "key_owner", "below"))
    once = named.withColumn("_n", first).where("_n = 1")
    details = F.map_concat(F.create_map(F.lit("phase"), F.col("phase")), _offline(), F.when(F.col("policy_name").isNotNull(), F.create_map(F.lit("policyName"), F.col("policy_name"))).otherwise(F.create_map().cast("map<string,string>")))
    line = F.trim(F.concat(F.lit('"'), F.col("full"), F.lit('" '), F.col("parameters")))
    policy = once.select("load_idx", F.lit("registry").alias("loc_kind"), _shown(F.col("below")).alias("loc_path"), F.lit(None).cast("string").alias("loc_item"), F.lit("automatic").alias("activation"), line.alias("line"), details.alias("details"))
    own = r.where((F.col("hive") == "HKU") & (F.col("low_key") == "environment") & (F.col("low_name") == "userinitmprlogonscript"))
    own = own.select("load_idx", F.lit("registry"), _shown(F.lit("Environment")), F.lit("UserInitMprLogonScript"), F.lit("automatic"), "line", F.map_concat(F.create_map(F.lit("phase"), F.lit("logon")), _offline()))
    return policy.union(own)


def relative_path(path: Column) -> Column:
    """A WMI path without server and namespace."""
    return F.regexp_replace(path, r"^(?:\\\\[^\\]*\\[^:]*:|[^:\"]*:(?=[A-Za-z_]+\.))", "")


def subscriptions(wmi: DataFrame) -> DataFrame:
    """Consumers that run commands or scripts: load_idx, class, loc_path, activation, engine, script text and file, line, details, folder.

    A consumer is bound if a binding names it; the first binding's filter tells
    the query.
    """
    w = wmi.where(F.upper("namespace").isin("ROOT\\SUBSCRIPTION", "ROOT\\DEFAULT")).withColumn("own", F.lower(relative_path(F.col("path"))))
    prop = lambda name: F.nullif(F.trim(F.get(F.map_values(F.map_filter("properties", lambda k, v: F.lower(k) == name.lower())), F.lit(0))), F.lit(""))
    bindings = w.where("class = '__FilterToConsumerBinding'").select("load_idx", "namespace", F.lower(relative_path(prop("Consumer"))).alias("own"), F.lower(relative_path(prop("Filter"))).alias("filter"), F.col("path").alias("_b"))
    first = bindings.groupBy("load_idx", "namespace", "own").agg(F.min_by("filter", "_b").alias("filter"))
    filters = w.where("class = '__EventFilter'").select("load_idx", "namespace", F.col("own").alias("filter"), prop("Query").alias("query"))
    found = w.where(F.col("class").isin("ActiveScriptEventConsumer", "CommandLineEventConsumer"))
    found = found.join(first.withColumn("bound", F.lit(True)), ["load_idx", "namespace", "own"], "left").join(filters, ["load_idx", "namespace", "filter"], "left")
    bound = F.coalesce("bound", F.lit(False))
    program, template = F.coalesce(prop("ExecutablePath"), F.lit("")), F.coalesce(prop("CommandLineTemplate"), F.lit(""))
    apart = (program != "") & (template != "") & ~F.lower(template).contains(F.lower(F.regexp_extract(program, r"([^\\/]*)$", 1)))
    line = F.when(apart, F.concat(F.lit('"'), F.regexp_replace(program, '^"+|"+$', ""), F.lit('" '), template)).when(template != "", template).otherwise(program)
    query = F.when(F.col("query").isNotNull(), F.create_map(F.lit("eventQuery"), F.col("query"))).otherwise(F.create_map().cast("map<string,string>"))
    details = F.map_concat(F.create_map(F.lit("consumerClass"), F.col("class"), F.lit("bound"), bound.cast("string")), query)
    return found.select(
        "load_idx", "class", F.lit("wmi").alias("loc_kind"), F.concat("namespace", F.lit(":"), relative_path(F.col("path"))).alias("loc_path"), F.lit(None).cast("string").alias("loc_item"),
        F.when(bound, "automatic").otherwise("dormant").alias("activation"), prop("ScriptingEngine").alias("engine"), prop("ScriptText").alias("script_text"), prop("ScriptFileName").alias("script_file"), line.alias("line"), details.alias("details"), prop("WorkingDirectory").alias("folder"),
    )


def installed_packages(registry: DataFrame, files: DataFrame, variables: DataFrame | None = None) -> DataFrame:
    """Findings of the packages that the machine keeps of its installed products.

    A package without a row in `files` (load_idx, path, content, problem), or
    one that access is denied to, gives none.
    """
    pattern = "^" + (CURRENT + "installer\\userdata\\").replace("\\", "\\\\") + r"[^\\]+\\products\\([^\\]+)\\installproperties$"
    r = registry.where((F.col("hive") == "HKLM") & (F.col("view") == "native") & F.lower("key").rlike(pattern) & (F.trim("value") != ""))
    value = lambda name: F.max(F.when(F.lower("name") == name, F.col("value")))
    packed = F.regexp_extract("key", "(?i)" + pattern, 1)
    products = r.groupBy("load_idx", F.lower("key").alias("key")).agg(
        F.min(packed).alias("packed"), value("localpackage").alias("packagePath"), value("displayname").alias("productName"), value("displayversion").alias("productVersion"), value("publisher").alias("publisher"),
    ).where(F.col("packagePath").isNotNull())
    details = F.to_json(F.struct("packagePath", "productName", "productVersion", "publisher"))
    products = products.select("load_idx", "packed", F.col("packagePath").alias("path"), details.alias("details"))
    return detect.detect_packages(products, files, variables)


def detect_all(registry: DataFrame, wmi: DataFrame | None = None, files: DataFrame | None = None, variables: DataFrame | None = None) -> DataFrame:
    """Findings of all entries.

    With `files` (load_idx, path, content, problem), commands are followed into
    the scripts that they call, and installed packages are read; `variables`
    (load_idx, variables map<string,string>) are the machines'.
    """
    lines = detect.commands(autostart(registry), "VBS-311", "VBS-312", "autostart")
    lines = lines.union(detect.commands(services(registry), "VBS-321", "VBS-322", "services"))
    lines = lines.union(detect.commands(logon_scripts(registry), "VBS-341", "VBS-342", "logonScripts"))
    if wmi is not None:
        found = subscriptions(wmi)
        lines = lines.union(detect.commands(found.where("class = 'CommandLineEventConsumer'").select(*COLUMNS), "VBS-331", "VBS-332", "wmi"))
    out = detect.detect_lines(lines, files, variables)
    if wmi is not None:
        out = out.union(detect.detect_consumers(found.where("class = 'ActiveScriptEventConsumer' and lower(engine) like '%vbscript%'")))
    if files is not None:
        out = out.union(installed_packages(registry, files, variables))
    return out


def machine_id(guid: Column, prefix: str) -> Column:
    """A machine's id: a hash of its GUID, behind a fixed prefix."""
    return F.sha2(F.concat(F.lit(prefix), F.lower(F.trim(guid))), 256)


def os_name(product: Column, build: Column, product_type: Column) -> Column:
    """Workstations from build 22000 on still call themselves by the name before."""
    newer = (build >= 22000) & (product_type == "workstation")
    return F.when(newer, F.regexp_replace(product, "Windows 10", "Windows 11")).otherwise(product)


def unloaded_profiles(profiles: DataFrame, loaded: DataFrame) -> DataFrame:
    """Profiles (load_idx, sid, folder) whose hive isn't loaded (load_idx, sid): their hive files are read instead."""
    return profiles.withColumn("_sid", F.lower("sid")).join(loaded.select("load_idx", F.lower("sid").alias("_sid")).distinct(), ["load_idx", "_sid"], "left_anti").drop("_sid")
