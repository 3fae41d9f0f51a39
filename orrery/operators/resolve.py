"""IMPORTS and CALLS edges from parses, as equi-joins with an "exactly one candidate" rule.

Each step of a cascade says to which sites it applies; a step that applies and finds no single candidate is a decided miss
and stops the steps after it. Edges are rather missing than wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions.text import argument_count

CODE = ("typescript", "tsx", "javascript")
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", "/index.ts", "/index.tsx", "/index.js")


def import_edges(parses: DataFrame, symbols: DataFrame) -> DataFrame:
    """src, dst: modules of files of one repository; imports of what is not in it, or is ambiguous, have none."""
    modules = symbols.where("kind = 'module'").select(F.col("file").alias("path"), F.col("id").alias("dst"))
    refs = parses.select("path", "language", F.explode("imports").alias("target")).withColumn("ref", F.xxhash64("path", "target"))
    # Java: the whole name, then without its last part (a static member), names one class of one file
    java = refs.where("language = 'java'")
    names = F.array("target", F.regexp_replace("target", r"\.[^.]*$", ""))
    java = java.select("path", "ref", F.posexplode(names).alias("priority", "qname"))
    classes = symbols.where("language = 'java' AND kind IN ('class', 'interface')").groupBy("qname").agg(F.count_distinct("file").alias("n"), F.min("file").alias("file"))
    java = java.join(classes, "qname").groupBy("path", "ref").agg(F.min_by("file", "priority").alias("file"), F.min_by("n", "priority").alias("n")).where("n = 1")
    java = java.select("path", F.col("file").alias("to"))
    # Python: absolute, or relative by its leading dots
    dots = F.length(F.regexp_extract("target", r"^\.*", 0))
    rest = F.replace(F.regexp_replace("target", r"^\.*", ""), F.lit("."), F.lit("/"))
    folders = F.split("path", "/")
    base = F.array_join(F.slice(folders, F.lit(1), F.greatest(F.size(folders) - dots, F.lit(0))), "/")
    stem = F.when(dots == 0, rest).otherwise(F.concat_ws("/", F.nullif(base, F.lit("")), F.nullif(rest, F.lit(""))))
    python = refs.where("language = 'python'").withColumn("stem", stem)
    start = F.when(F.col("stem") == "", F.lit("__init__.py")).otherwise(F.concat("stem", F.lit("/__init__.py")))
    python = python.select("path", "ref", F.posexplode(F.array(F.concat("stem", F.lit(".py")), start)).alias("priority", "to"))
    # TypeScript: relative (or @/ for src/), by suffixes
    ts = refs.where(F.col("language").isin(*CODE) & F.col("target").rlike(r"^(\.|@/)"))
    here = F.array_join(F.slice(folders, F.lit(1), F.size(folders) - 1), "/")
    joined = F.when(F.col("target").startswith("@/"), F.concat(F.lit("src/"), F.expr("substring(target, 3)"))).otherwise(F.concat_ws("/", F.nullif(here, F.lit("")), "target"))
    up = lambda s, x: F.when((x != "..") | (F.size(s) == 0) | (F.element_at(s, -1) == ".."), F.concat(s, F.array(x))).otherwise(F.slice(s, F.lit(1), F.size(s) - 1))
    parts = F.filter(F.split(joined, "/"), lambda x: ~x.isin("", "."))
    ts = ts.withColumn("stem", F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/"))
    ts = ts.where(~F.col("stem").startswith("..")).select("path", "ref", F.posexplode(F.array(*(F.concat("stem", F.lit(x)) for x in SUFFIXES))).alias("priority", "to"))
    found = python.unionByName(ts).join(modules.select(F.col("path").alias("to")), "to", "left_semi")
    found = found.groupBy("path", "ref").agg(F.min_by("to", "priority").alias("to")).select("path", "to")
    out = java.unionByName(found).where("path <> to").distinct()
    source = modules.select("path", F.col("dst").alias("src"))
    return out.join(source, "path").join(modules.withColumnRenamed("path", "to"), "to").select("src", "dst")


def _pick(cands: DataFrame) -> DataFrame:
    """site, dst. cands: site, argc, id, sig_argc."""
    same = F.col("argc") == F.col("sig_argc")
    per = cands.distinct().groupBy("site").agg(
        F.count("*").alias("n"), F.count_if(same).alias("equal"), F.count_if(F.col("argc") != F.col("sig_argc")).alias("unequal"), F.min("id").alias("only"), F.min(F.when(same, F.col("id"))).alias("match")
    )
    dst = F.when((F.col("n") == 1) & (F.col("unequal") == 0), F.col("only")).when((F.col("n") > 1) & (F.col("equal") == 1), F.col("match"))
    return per.select("site", dst.alias("dst"))


def call_edges(parses: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """src, dst, resolution, line, col. imports: edges of :func:`import_edges`."""
    module_of = symbols.where("kind = 'module'").select(F.col("file").alias("file"), F.col("id").alias("module"))
    syms = symbols.withColumn("sig_argc", argument_count(F.col("signature")))
    own = syms.select("file", F.col("idx").alias("caller"), F.col("id").alias("src"), F.regexp_extract("qname", "^(.*)#[^#]*$", 1).alias("owner"))
    sites = parses.select(F.col("path").alias("file"), "language", F.explode("calls").alias("c")).select("file", "language", "c.*")
    sites = sites.withColumn("caller", F.coalesce("caller", F.lit(0))).join(own, ["file", "caller"])
    sites = sites.withColumn("site", F.xxhash64("file", "line", "col", "name", "kind"))
    methods = syms.where("kind IN ('method', 'function')").select("id", F.col("file").alias("to"), "name", "sig_argc", F.regexp_extract("qname", "^(.*)#[^#]*$", 1).alias("owner"))
    classes = syms.where("kind IN ('class', 'interface')").select(F.col("id").alias("class_id"), F.col("file").alias("to"), F.col("name").alias("short"), F.regexp_replace("qname", r"@\d+$", "").alias("qname"))
    binds = parses.select(F.col("path").alias("file"), F.explode("bindings").alias("b")).select("file", F.col("b.name").alias("bound"), F.col("b.source").alias("source"), F.col("b.kind").alias("how"), F.coalesce("b.target", "b.name").alias("target"))
    # what a file's imports may reach: its edges, as files
    files = module_of.withColumnsRenamed({"file": "f", "module": "m"})
    reach = imports.join(files.select(F.col("m").alias("src"), F.col("f").alias("file")), "src").join(files.select(F.col("m").alias("dst"), F.col("f").alias("to")), "dst").select("file", "to")
    one_class = classes.groupBy("short").agg(F.count("*").alias("n"), F.min("qname").alias("qname")).where("n = 1").select("short", "qname")

    def in_class(df):  # site, argc, name, qname
        m = methods.select("id", "name", "sig_argc", F.col("owner").alias("qname"))
        return df.join(m, ["qname", "name"]).select("site", "argc", "id", "sig_argc")

    plain = sites.where("kind <> 'new'")
    bare = plain.where("receiver IS NULL OR receiver IN ('this', 'self', 'super')")
    steps = []
    own_class = in_class(bare.where("owner <> ''").select("site", "argc", "name", F.col("owner").alias("qname")))
    steps.append(("exact", _pick(own_class).where("dst IS NOT NULL")))
    lexical = bare.where("local").select("site", F.lit(None).cast("long").alias("dst"))
    steps.append(("exact", lexical))
    # named imports: of a class's static member (Java), or of a function in a module that the file imports
    named = plain.where("receiver IS NULL").join(binds.where("how IN ('named', 'default')"), (sites["name"] == binds["bound"]) & (sites["file"] == binds["file"])).drop(binds["file"])
    static = in_class(named.where("language = 'java'").select("site", "argc", "name", F.col("source").alias("qname")))
    free = methods.where("owner = ''").select("id", "to", F.col("name").alias("target"), "sig_argc")
    direct = named.where("language <> 'java'").join(reach, "file").join(free, ["to", "target"]).select("site", "argc", "id", "sig_argc")
    steps.append(("exact", named.select("site").distinct().join(_pick(static.unionByName(direct)), "site", "left")))
    same_file = bare.join(methods.withColumnRenamed("to", "file").drop("owner"), ["file", "name"]).select("site", "argc", "id", "sig_argc")
    steps.append(("exact", _pick(same_file).where("dst IS NOT NULL")))
    # a receiver that is a bound class or module
    with_owner = plain.where("receiver IS NOT NULL AND receiver NOT IN ('this', 'self', 'super')")
    bound = with_owner.join(binds, (sites["receiver"] == binds["bound"]) & (sites["file"] == binds["file"])).drop(binds["file"])
    by_class = in_class(bound.where("how = 'class'").select("site", "argc", "name", F.col("source").alias("qname")))
    in_module = bound.where("how = 'module'").join(reach, "file").join(methods.where("owner = ''").drop("owner"), ["to", "name"]).select("site", "argc", "id", "sig_argc")
    steps.append(("exact", bound.select("site").distinct().join(_pick(by_class.unionByName(in_module)), "site", "left")))
    by_short = with_owner.join(one_class, with_owner["receiver"] == one_class["short"])
    steps.append(("exact", by_short.select("site").distinct().join(_pick(in_class(by_short.select("site", "argc", "name", "qname"))), "site", "left")))
    typed = with_owner.where("receiver_type IS NOT NULL")
    bound_type = typed.join(binds.where("how = 'class'"), (typed["receiver_type"] == binds["bound"]) & (typed["file"] == binds["file"])).select("site", "argc", "name", F.col("source").alias("qname"))
    unique_type = typed.join(bound_type.select("site"), "site", "left_anti").join(one_class, typed["receiver_type"] == one_class["short"]).select("site", "argc", "name", "qname")
    steps.append(("exact", typed.select("site").distinct().join(_pick(in_class(bound_type.unionByName(unique_type))), "site", "left")))
    # constructions: the constructor by its arguments, else the class
    new = sites.where("kind = 'new'").join(one_class, F.col("name") == F.col("short"))
    built = new.select("site", "argc", "qname", F.explode(F.array(F.col("short"), F.lit("constructor"))).alias("name"))
    made = new.join(_pick(in_class(built)), "site", "left").join(classes.select("qname", "class_id"), "qname").groupBy("site").agg(F.min(F.coalesce("dst", "class_id")).alias("dst"))
    steps.append(("exact", made))
    # Python and Go: the only function of that name anywhere, but never the caller itself
    loose = plain.where("language IN ('python', 'go')").join(methods.select("id", "name", "sig_argc"), "name").where("id <> src").select("site", "argc", "id", "sig_argc")
    steps.append(("heuristic", _pick(loose).where("dst IS NOT NULL")))
    out = sites.select("site", "src", "line", "col").distinct()
    found = []
    for k, (kind, df) in enumerate(steps):
        per = df.groupBy("site").agg(F.min(F.coalesce("dst", F.lit(0))).alias(f"d{k}"))
        out = out.join(per, "site", "left")
        found.append(F.when(F.col(f"d{k}").isNotNull(), F.struct(F.nullif(F.col(f"d{k}"), F.lit(0)).alias("dst"), F.lit(kind).alias("resolution"))))
    out = out.withColumn("f", F.coalesce(*found)).where("f.dst IS NOT NULL")
    return out.select("src", "f.dst", "f.resolution", "line", "col").distinct()
