"""Flow-shaped views of the given tables, as column expressions both engines read.

``events`` stands for a labelled flow feed, ``lineitem`` for a numeric feature
table with dirty cells. Each view covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import config
from tidewatch.functions.labels import encode_labels, map_labels_strict, resolve_truth
from tidewatch.operators.scoring import with_verdict

BAD = "�"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# events as labelled flows ------------------------------------------------------

LABEL = f"""CASE
 WHEN event_id % 997 = 0 THEN 'Infiltration'
 WHEN event_id % 401 = 1 THEN ' Bot '
 WHEN event_id % 53 = 2 THEN 'Web Attack {BAD} XSS'
 WHEN event_id % 59 = 3 THEN 'Web Attack{BAD}Sql Injection'
 WHEN event_id % 23 = 4 THEN '  FTP-Patator'
 WHEN event_type = 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'DoS Hulk' ELSE 'DoS   slowloris  ' END
 WHEN event_type = 'purchase' THEN 'PortScan'
 ELSE 'Benign' END"""

TRUTH = f"""CASE
 WHEN event_id % 101 = 7 THEN 'nonsense'
 WHEN event_id % 3 = 0 THEN upper({LABEL})
 WHEN event_type = 'purchase' AND event_id % 3 = 1 THEN 'portscan'
 ELSE {LABEL} END"""

FLOW_COLUMNS = {
    "event_id": "event_id", "user_id": "user_id", "ts": "ts", "event_type": "event_type", "value": "value",
    "label_text": LABEL, "truth_text": TRUTH,
}

CENTRES = [5, 15, 30, 50, 80, 120, 180, 260]
SCORES = [
    f"(1.0 / (1.0 + abs(value - {c}.0)) + CASE WHEN event_id % 10 < 8 AND class_id = {k} THEN 3.0 ELSE 0.0 END)"
    for k, c in enumerate(CENTRES)
]


def flows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(*[f"{e} AS {n}" for n, e in FLOW_COLUMNS.items()])


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return encode_labels(map_labels_strict(flows(spark, sf), "label_text"), out="class_id")


def unscored(spark: SparkSession, sf: str) -> DataFrame:
    return resolve_truth(labelled(spark, sf), "truth_text")


def with_rule_probs(df: DataFrame) -> DataFrame:
    """Fixed scoring rule in place of a model, so that SQL can repeat it."""
    rows = df.withColumn("_scores", F.array(*[F.expr(e).cast("double") for e in SCORES]))
    total = F.aggregate("_scores", F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("_total", total)
    return rows.withColumn("probs", F.transform("_scores", lambda x: x / F.col("_total"))).drop("_scores", "_total")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return with_verdict(with_rule_probs(unscored(spark, sf)))


# several models over the same flows --------------------------------------------

MODELS = [("forest", 860), ("boosted", 930), ("boosted_deep", 925), ("network", 640), ("boosted_top", 935), ("boosted_tuned", 990)]
MODEL_HIT = "(event_id * 7919 + ord * 104729) % 1000 < hit"
MISS_ID = "(class_id + 1 + event_id % 7) % 8"


def model_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """(model, ord, event_id, truth, prediction) for six rule models."""
    variants = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(i).cast("long").alias("ord"), F.lit(h).alias("hit")) for i, (m, h) in enumerate(MODELS)])
    rows = labelled(spark, sf).select("event_id", "class_id", F.col("label_class").alias("truth"), F.inline(variants))
    names = F.array(*[F.lit(n) for n in config.CLASSES])
    missed = F.element_at(names, F.expr(MISS_ID).cast("int") + 1)
    return rows.select("model", "ord", "event_id", "truth", F.when(F.expr(MODEL_HIT), F.col("truth")).otherwise(missed).alias("prediction"))


# lineitem as a feature table ----------------------------------------------------

FEATURES = {
    "Total Packets": "CASE WHEN l_linenumber = 7 AND l_partkey % 5 = 0 THEN NULL ELSE l_quantity END",
    "Flow Bytes/s": "CASE WHEN l_partkey % 97 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN l_partkey % 89 = 0 THEN CAST('-Infinity' AS DOUBLE)"
    " WHEN l_suppkey % 53 = 0 THEN CAST('NaN' AS DOUBLE) ELSE l_extendedprice END",
    "Idle.Mean": "l_discount",
    "Active Std": "l_tax",
    "Charge": "l_quantity * 2 + l_tax",
    "Zero": "l_quantity * 0.0",
}
NAMES = list(FEATURES)
LIVE = NAMES[:5]
FEATURE_LABEL = (
    "CASE WHEN l_linenumber = 1 AND l_suppkey % 3 = 0 THEN 'DDoS' WHEN l_returnflag = 'R' THEN 'DoS Hulk' ELSE 'Benign' END"
)
FILES = {"A": config.MANIFEST[0], "N": config.MANIFEST[4], "R": config.MANIFEST[3]}
FEATURE_FILE = "CASE " + " ".join(f"WHEN l_returnflag = '{k}' THEN '{v}'" for k, v in FILES.items()) + " END"
KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def features(spark: SparkSession, sf: str, key: bool = False) -> DataFrame:
    keep = [f"{k} AS {k}" for k in KEY] if key else []
    return table(spark, sf, "lineitem").selectExpr(
        *keep, *[f"{e} AS `{n}`" for n, e in FEATURES.items()], f"{FEATURE_LABEL} AS Label", f"{FEATURE_FILE} AS source_file"
    )


# reference and current side for drift -------------------------------------------

DRIFT_FEATURES = ["quantity", "price", "discount", "tax", "flat"]
REFERENCE = ("l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_quantity * 0.0 AS flat", "l_suppkey % 2 = 0")
CURRENT = ("l_quantity + 9.0 AS quantity, l_extendedprice * 1.5 AS price, l_discount AS discount, l_tax * 1.0 AS tax, l_quantity * 0.0 AS flat", "l_suppkey % 2 = 1")


def drift_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two halves of lineitem by supplier; the second one is shifted in two columns."""
    rows = table(spark, sf, "lineitem")
    return tuple(rows.where(w).selectExpr(*[x.strip() for x in cols.split(", ")]) for cols, w in (REFERENCE, CURRENT))


# SQL forms ----------------------------------------------------------------------

def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def ident(name: str) -> str:
    return '"' + name + '"'


def norm_sql(x: str) -> str:
    return f"regexp_replace(replace(trim({x}), '{BAD}', ' - '), ' {{2,}}', ' ', 'g')"


def finite_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL AND NOT isnan({x}) AND NOT isinf({x}) THEN {x} END"


_truth_lookup = {c.lower(): c for c in config.LABEL_MAP.values()} | {k.lower(): v for k, v in config.LABEL_MAP.items()}
_s_total = " + ".join(f"s{k}" for k in range(8))
_p_list = ", ".join(f"p{k}" for k in range(8))

CTES: dict[str, tuple[list[str], str]] = {
    "flows": ([], "SELECT " + ", ".join(f"{e} AS {n}" for n, e in FLOW_COLUMNS.items()) + " FROM events"),
    "label_map": ([], "SELECT * FROM (VALUES " + ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in config.LABEL_MAP.items()) + ") AS t(norm, label_class)"),
    "classes": ([], "SELECT * FROM (VALUES " + ", ".join(f"({i}, {quoted(n)})" for n, i in config.CLASS_IDS.items()) + ") AS t(class_id, label_class)"),
    "truth_map": ([], "SELECT * FROM (VALUES " + ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in _truth_lookup.items()) + ") AS t(norm, truth)"),
    "labelled": (
        ["flows", "label_map", "classes"],
        f"SELECT f.*, m.label_class, c.class_id FROM flows f JOIN label_map m ON {norm_sql('f.label_text')} = m.norm JOIN classes c ON c.label_class = m.label_class",
    ),
    "scored": (
        ["labelled", "truth_map"],
        "SELECT u.*, prediction <> 'BENIGN' AS is_attack FROM (SELECT t.*, CASE "
        + " ".join(f"WHEN p{k} = confidence THEN {quoted(n)}" for k, n in enumerate(config.CLASSES))
        + f" END AS prediction FROM (SELECT r.*, greatest({_p_list}) AS confidence FROM (SELECT q.*, "
        + ", ".join(f"s{k} / ({_s_total}) AS p{k}" for k in range(8))
        + " FROM (SELECT l.*, m.truth, " + ", ".join(f"{e} AS s{k}" for k, e in enumerate(SCORES))
        + f" FROM labelled l LEFT JOIN truth_map m ON lower({norm_sql('l.truth_text')}) = m.norm) q) r) t) u",
    ),
    "models": ([], "SELECT * FROM (VALUES " + ", ".join(f"({quoted(m)}, CAST({i} AS BIGINT), {h})" for i, (m, h) in enumerate(MODELS)) + ") AS t(model, ord, hit)"),
    "model_verdicts": (
        ["labelled", "models", "classes"],
        f"SELECT m.model, m.ord, l.event_id, l.label_class AS truth, CASE WHEN {MODEL_HIT} THEN l.label_class ELSE c.label_class END AS prediction"
        f" FROM labelled l, models m, classes c WHERE c.class_id = (l.class_id + 1 + l.event_id % 7) % 8",
    ),
    "features": (
        [],
        "SELECT " + ", ".join(KEY) + ", " + ", ".join(f"{e} AS {ident(n)}" for n, e in FEATURES.items())
        + f', {FEATURE_LABEL} AS "Label", {FEATURE_FILE} AS source_file FROM lineitem',
    ),
    "reference": ([], f"SELECT {REFERENCE[0]} FROM lineitem WHERE {REFERENCE[1]}"),
    "current_side": ([], f"SELECT {CURRENT[0]} FROM lineitem WHERE {CURRENT[1]}"),
}


def per_class_ctes(pairs: str, by: str) -> str:
    """``pc``: per-class counts and rates of a (by, truth, prediction, n) table."""
    b = f"{by}, " if by else ""
    on = "".join(f" AND x.{k.strip()} = f.{k.strip()}" for k in by.split(",") if k)
    grp = f"GROUP BY {by}" if by else ""
    return (
        f"side AS (SELECT {b}truth AS label_class, n AS support, 0 AS predicted, CASE WHEN truth = prediction THEN n ELSE 0 END AS tp FROM {pairs}"
        f" UNION ALL SELECT {b}prediction, 0, n, 0 FROM {pairs}), "
        f"sums AS (SELECT {b}label_class, CAST(sum(support) AS BIGINT) AS support, CAST(sum(predicted) AS BIGINT) AS predicted, CAST(sum(tp) AS BIGINT) AS tp FROM side GROUP BY {b}label_class), "
        f"frame AS (SELECT t.*, c.class_id, c.label_class FROM (SELECT {b}CAST(sum(n) AS BIGINT) AS total FROM {pairs} {grp}) t, classes c), "
        f"cnt AS (SELECT f.*, coalesce(x.support, 0) AS support, coalesce(x.predicted, 0) AS predicted, coalesce(x.tp, 0) AS tp FROM frame f LEFT JOIN sums x ON x.label_class = f.label_class{on}), "
        f"rate AS (SELECT *, support - tp AS fn, predicted - tp AS fp, CASE WHEN predicted = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / predicted END AS pr,"
        f" CASE WHEN support = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / support END AS rc FROM cnt), "
        f"pc AS (SELECT {b}class_id, label_class, support, CASE WHEN support > 0 THEN pr END AS precision, CASE WHEN support > 0 THEN rc END AS recall,"
        f" CASE WHEN support > 0 THEN CASE WHEN pr + rc = 0 THEN 0.0 ELSE 2 * pr * rc / (pr + rc) END END AS f1,"
        f" CASE WHEN support > 0 THEN CAST(fn AS DOUBLE) / support END AS fnr, tp, fn, fp, total - tp - fn - fp AS tn, support = 0 AS insufficient_test_support FROM rate)"
    )


def summary_cte(by: str) -> str:
    """``sm``: the summary over ``pc``."""
    b = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    attack = "support > 0 AND label_class <> 'BENIGN'"
    macro = ", ".join(f"coalesce(avg(CASE WHEN support + fp > 0 THEN coalesce({m}, 0.0) END), 0.0) AS macro_{m}" for m in ("f1", "precision", "recall"))
    weighted = ", ".join(f"sum(coalesce({m}, 0.0) * support) / sum(support) AS weighted_{m}" for m in ("f1", "precision", "recall"))
    mean = lambda c, m, n: f"coalesce(avg(CASE WHEN {c} THEN {m} END), 0.0) AS {n}"
    return (
        f"sm AS (SELECT {b}CAST(sum(support) AS BIGINT) AS test_samples, CAST(sum(tp) AS DOUBLE) / sum(support) AS accuracy, {macro}, {weighted}, "
        + ", ".join([
            mean("support > 0", "fnr", "mean_fnr"), mean(attack, "fnr", "mean_attack_fnr"), mean(attack, "f1", "macro_attack_f1"),
            mean(attack, "recall", "macro_attack_recall"), mean(attack + " AND support < 500", "f1", "mean_minority_f1"),
            mean(attack + " AND support < 500", "fnr", "mean_minority_fnr"),
        ])
        + f" FROM pc {grp})"
    )


def sql(uses: list[str], body: str, extra: list[str] | None = None) -> str:
    """A statement with the views it uses in front, each once and in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for dep in CTES[name][0]:
            add(dep)
        if name not in order:
            order.append(name)

    for u in uses:
        add(u)
    parts = [f"{n} AS ({CTES[n][1]})" for n in order] + list(extra or [])
    return (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + body


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Report rounding of the named columns; the others stay."""
    names = set(columns)
    return df.select(*[F.round(F.col(f"`{n}`"), digits).alias(n) if n in names else F.col(f"`{n}`") for n in df.columns])
