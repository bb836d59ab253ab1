"""Code dictionaries, ICD conversion and hierarchical diagnosis-path resolution
(A3, A4, C5, C7-C18, D9, D10, D15, G7, G8, G18).

Prefix and substring matches are never nested loops: the known side is exploded into its
prefixes/substrings once and the lookups become equi-joins. Dictionaries with duplicate
keys are deduplicated with an explicit rule (smallest value) because a distributed table
has no "last row".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.operators.util import mode_smallest
from wardspark.sources.stage import cut


# ----------------------------------------------------------------------------- readers
def strip_quotes(c: str) -> Column:
    """``s[1:-1]``: drop the first and the last character."""
    return F.expr(f"substring({c}, 2, greatest(length({c}) - 2, 0))")


def clean_ccs(raw: DataFrame, code: str = "icd_raw", cls: str = "class_raw") -> DataFrame:
    """Quoted single-level CCS rows -> (code, class); spaces inside the code are removed."""
    return raw.select(F.replace(strip_quotes(code), F.lit(" "), F.lit("")).alias("code"),
                      strip_quotes(cls).cast("int").alias("class"))


def parse_whitespace_table(text: DataFrame, names: list[str], value: str = "value") -> DataFrame:
    """Header-less, whitespace-delimited lines (``read_csv(sep='\\s+', header=None)``)."""
    parts = F.split(F.trim(F.regexp_replace(F.col(value), r"\s+", " ")), " ")
    return text.select(*[F.try_element_at(parts, F.lit(i + 1)).alias(n) for i, n in enumerate(names)])


def dedupe_min(df: DataFrame, key: str, value: str) -> DataFrame:
    """One value per key: the smallest (explicit replacement for dict(zip()) last-wins)."""
    return df.groupBy(key).agg(F.min(value).alias(value))


def map_codes(df: DataFrame, col: str, dictionary: DataFrame, key: str, value: str,
              out: str) -> DataFrame:
    """Left dictionary lookup; missing keys give NULL (the reference's string 'nan')."""
    dct = dedupe_min(dictionary, key, value).withColumnRenamed(key, "_k").withColumnRenamed(value, out)
    return df.join(dct, df[col] == dct["_k"], "left").drop("_k")


# ----------------------------------------------------------------------------- classes
def class_sets(dx: DataFrame, ccs: DataFrame, key: str = "stay_id", code: str = "code") -> DataFrame:
    """Distinct sorted class list per key; unmapped codes are dropped."""
    m = dx.join(ccs.select(F.col("code").alias(code), "class"), code)
    return m.groupBy(key).agg(F.array_sort(F.collect_set("class")).alias("classes"))


def with_empty_classes(keys: DataFrame, sets: DataFrame, key: str = "stay_id") -> DataFrame:
    out = keys.join(sets, key, "left")
    return out.withColumn("classes", F.coalesce("classes", F.array().cast("array<int>")))


def multi_hot(classes: Column, n: int = 18) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(n)),
                       lambda c: F.array_contains(classes, c).cast("int"))


def length_stats(sets: DataFrame, col: str = "classes") -> DataFrame:
    """Histogram of list lengths with the global mean/min/max on every row."""
    from pyspark.sql import Window
    h = sets.groupBy(F.size(col).alias("n_classes")).agg(F.count(F.lit(1)).alias("n_stays"))
    w = Window.partitionBy()
    tot = F.sum("n_stays").over(w)
    return h.select("n_classes", "n_stays",
                    F.round(F.sum(F.col("n_classes") * F.col("n_stays")).over(w) / tot, 6).alias("avg_len"),
                    F.min("n_classes").over(w).alias("min_len"), F.max("n_classes").over(w).alias("max_len"))


# ----------------------------------------------------------------------------- ICD-10 -> 9
def unmapped(codes: DataFrame, gem: DataFrame, code: str = "code") -> DataFrame:
    """Distinct codes without an exact equivalence row."""
    return codes.select(code).distinct().join(gem.select(F.col("icd10").alias(code)), code, "left_anti")


def substring_counts(gem: DataFrame) -> DataFrame:
    """(sub, icd9, n): number of equivalence rows whose ICD-10 text contains ``sub``."""
    mult = gem.groupBy("icd10", "icd9").agg(F.count(F.lit(1)).alias("mult"))
    n = F.length("icd10")
    subs = mult.select("icd10", "icd9", "mult", F.explode(F.sequence(F.lit(1), n)).alias("s"))
    subs = subs.select("icd10", "icd9", "mult",
                       F.explode(F.sequence(F.col("s"), F.length("icd10"))).alias("e"), "s")
    subs = subs.select("icd10", "icd9", "mult", F.substring("icd10", F.col("s"), F.col("e") - F.col("s") + 1).alias("sub"))
    subs = subs.dropDuplicates(["icd10", "icd9", "sub"])
    return subs.groupBy("sub", "icd9").agg(F.sum("mult").alias("n"))


def prefix_fallback(codes: DataFrame, gem: DataFrame, code: str = "code") -> DataFrame:
    """Longest prefix of each code that occurs inside any known ICD-10 code, then the modal
    ICD-9 of the rows containing it (ties: smallest). Codes with no match are absent."""
    pre = codes.select(code, F.explode(F.sequence(F.length(code), F.lit(1), F.lit(-1))).alias("plen"))
    pre = pre.select(code, "plen", F.substring(code, 1, F.col("plen")).alias("sub"))
    # one modal row per substring first, so a prefix meets one row however many codes contain it
    modal = substring_counts(gem).groupBy("sub").agg(
        F.min(F.struct((-F.col("n")).alias("n"), F.col("icd9").alias("icd9"))).alias("_m"))
    hits = pre.join(modal, "sub")
    return hits.groupBy(code).agg(F.max_by("_m", "plen").alias("_p")).select(code, F.col("_p.icd9").alias("icd9"))


def icd_convert(dx: DataFrame, gem: DataFrame, code: str = "code", ver: str = "ver",
                out: str = "converted") -> DataFrame:
    """Version 9 codes unchanged; version 10 by exact equivalence, else by prefix fallback."""
    exact = dedupe_min(gem, "icd10", "icd9")
    ten = dx.where(F.col(ver) == 10).select(code).distinct()
    fb = prefix_fallback(unmapped(ten, gem, code), gem, code).withColumnRenamed("icd9", "_fb")
    m = (dx.join(exact.withColumnRenamed("icd10", code).withColumnRenamed("icd9", "_ex"), code, "left")
           .join(fb, code, "left"))
    conv = F.when(F.col(ver) == 9, F.col(code)).otherwise(F.coalesce("_ex", "_fb"))
    return m.withColumn(out, conv).drop("_ex", "_fb")


def modal_code(df: DataFrame, key: str, value: str, out: str = "mode") -> DataFrame:
    return mode_smallest(df, [key], value, out)


# ----------------------------------------------------------------------------- paths
def parent_path(p: Column, levels: int = 1) -> Column:
    """Path minus its last ``levels`` segments ('' when nothing is left)."""
    parts = F.split(p, r"\|")
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - levels, F.lit(0))), "|")


def first_code(codes: Column) -> Column:
    return F.replace(F.split_part(codes, F.lit(","), F.lit(1)), F.lit("."), F.lit(""))


def _prefix_rows(m: DataFrame, segment: bool) -> DataFrame:
    """Explode each (path, class) into all its prefixes (char or whole-segment), '' included."""
    if segment:
        parts = F.split("path", r"\|")
        x = m.select("class", parts.alias("_p"), F.explode(F.sequence(F.lit(0), F.size(parts))).alias("_l"))
        return x.select(F.array_join(F.slice("_p", 1, F.col("_l")), "|").alias("prefix"), "class")
    x = m.select("path", "class", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("_l"))
    return x.select(F.expr("substring(path, 1, _l)").alias("prefix"), "class")


def _prefix_counts(m: DataFrame, probes: DataFrame, segment: bool) -> DataFrame:
    """(prefix, class, n): known paths of each class below each probed prefix."""
    rows = _prefix_rows(m, segment).join(probes, "prefix", "left_semi")
    return rows.groupBy("prefix", "class").agg(F.count(F.lit(1)).alias("n"))


def _by_prefix(todo: DataFrame, counts: DataFrame, probe: Column, several: bool) -> DataFrame:
    """Every path with the class of its probe prefix, or NULL: the prefix must cover known paths of
    exactly one class or, if ``several``, of more than one (the most frequent; ties: smallest)."""
    merged = counts.groupBy("prefix", "class").agg(F.sum("n").alias("n"))
    stats = merged.groupBy("prefix").agg(
        F.count(F.lit(1)).alias("_k"),
        F.min(F.struct((-F.col("n")).alias("n"), F.col("class").alias("c"))).alias("_m"))
    stats = stats.where(F.col("_k") > 1 if several else F.col("_k") == 1)
    t = todo.select("path", probe.alias("prefix"))
    return t.join(stats, "prefix", "left").select("path", F.col("_m.c").alias("class"))


STEPS = ("direct", "icd10", "override", "parent", "descendants", "siblings", "ancestor_mode")


def resolve_paths(wanted: DataFrame, known: DataFrame, ccs: DataFrame, gem: DataFrame,
                  overrides: DataFrame, segment_prefix: bool = False,
                  ancestor_levels: tuple[int, ...] = (4,), until: str = STEPS[-1]) -> DataFrame:
    """Cascade ``(path) -> (path, class, resolved_by)``; every step sees only what the earlier
    steps left unresolved (an ordered coalesce). Unresolved wanted paths get class NULL.

    Steps: direct code, single ICD-10 code via the equivalence table, manual overrides,
    parent, descendants (one class), siblings (one class), ancestor mode; those after ``until``
    aren't computed. ``segment_prefix`` switches the prefix test from characters (the reference) to
    whole segments; ``ancestor_levels`` (4,) reproduces the reference, (1, 2, 3, 4) tries nearest first.

    Known paths are exploded into prefixes once, and only prefixes that some open path asks for
    are kept; a step adds the prefixes of the paths that it resolved.
    """
    last = STEPS.index(until)
    ccs_b = ccs.select(F.col("code").alias("_c"), "class")
    k = known.select("path", "codes", first_code(F.col("codes")).alias("_c"))
    direct = k.join(ccs_b, "_c").groupBy("path").agg(F.min("class").alias("class"))
    rest = (known.join(direct.select("path"), "path", "left_anti")
                 .groupBy("path").agg(F.min("codes").alias("codes"))
                 .withColumn("_n", F.size(F.split("codes", ","))))
    exact = dedupe_min(gem, "icd10", "icd9")
    one = rest.where(F.col("_n") == 1).select("path", F.replace(F.col("codes"), F.lit("."), F.lit("")).alias("icd10"))
    icd10 = (one.join(exact, "icd10").withColumnRenamed("icd9", "_c").join(ccs_b, "_c")
                .groupBy("path").agg(F.min("class").alias("class")))
    ovr = (rest.join(icd10.select("path"), "path", "left_anti").select("path")
               .join(overrides.groupBy("path").agg(F.min("class").alias("class")), "path"))
    out = direct.withColumn("resolved_by", F.lit(STEPS[0]))
    for name, part in list(zip(STEPS[1:3], (icd10, ovr)))[:last]:
        out = out.unionByName(part.withColumn("resolved_by", F.lit(name)))
    if last > 2:
        out = cut(out)
    m = out.select("path", "class")
    todo = wanted.select("path").distinct().join(m.select("path"), "path", "left_anti")

    # A step's output is dictionary-sized: (path, class or NULL) of all paths open before it. Cutting
    # it once keeps the plan linear, and both the resolved and the open paths are read from it.
    path = F.col("path")
    steps = [(3, None, False), (4, path, False), (5, parent_path(path), False),
             *[(6, parent_path(path, lv), True) for lv in ancestor_levels]]
    counts = probes = None
    for at, probe, several in steps:
        if at > last:
            break
        if probe is None:
            up = m.select(F.col("path").alias("_pp"), "class")
            tried = todo.select("path", parent_path(path).alias("_pp")).join(up, "_pp", "left").select("path", "class")
        else:
            if counts is None:
                asked = F.array(*[p for _, p, _ in steps if p is not None])
                probes = todo.select(F.explode(asked).alias("prefix")).distinct()
                counts = cut(_prefix_counts(m, probes, segment_prefix))
            tried = _by_prefix(todo, counts, probe, several)
        tried = cut(tried)
        got = tried.where(F.col("class").isNotNull())
        todo = tried.where(F.col("class").isNull()).select("path")
        out = out.unionByName(got.withColumn("resolved_by", F.lit(STEPS[at])))
        if counts is None:
            m = m.unionByName(got)
        elif not several:
            counts = counts.unionByName(_prefix_counts(got, probes, segment_prefix))
    return out.unionByName(todo.select("path", F.lit(None).cast("int").alias("class"), F.lit("unresolved").alias("resolved_by")))


def apply_path_map(stay_paths: DataFrame, resolved: DataFrame, key: str = "stay_id") -> DataFrame:
    """Per stay, the distinct sorted classes of its paths; unresolved paths are dropped."""
    r = resolved.where(F.col("class").isNotNull()).select("path", "class")
    return stay_paths.join(r, "path").groupBy(key).agg(F.array_sort(F.collect_set("class")).alias("classes"))
