"""Text and question operators over tables of texts.

Each works on whole texts with built-in string/regex functions (JVM-side, no Python UDF).
Per-conversation windows are made skew-safe: a conversation may hold a third of all turns,
so the last-N window first keeps the top N inside salted sub-groups, then ranks the (at most
N x salts) survivors per conversation.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# Fixed values used by the planning and routing behaviour.
DEFAULT_PLAN = [
    "Summarize dataset size, target balance, and data quality.",
    "Compute the key outcome rate and break it down by the main categorical drivers.",
    "If a time column exists, show the outcome trend over time.",
    "Surface the top insight for leadership with a confidence level.",
]
MAX_PLAN_STEPS = 5
MODEL_WORDS = ["model", "accuracy", "auc", "best", "won", "algorithm"]
CHART_WORDS = ["chart", "dashboard", "visual", "graph", "plot"]
DRIVER_WORDS = ["driver", "strongest", "cause", "why", "factor", "loss"]
TREND_WORDS = ["trend", "over time", "rising", "falling"]
CHAT_TURNS = 12
NO_FINDINGS = "No findings yet."
MAX_OUTPUT_CHARS = 1000
MAX_LIMITATIONS = 3

# Python's str.splitlines boundaries and str.strip whitespace, as Java regex.
_LINE_SPLIT = r"\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
_WS = r"[\t\n\u000b\u000c\r\u001c-\u001f \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


# the same whitespace set as literal characters, for btrim (linear, no regex backtracking)
_WS_CHARS = ("\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680"
             + "".join(chr(c) for c in range(0x2000, 0x200b)) + "\u2028\u2029\u202f\u205f\u3000")


def pystrip(c: Column) -> Column:
    """Strip leading/trailing whitespace the way Python's str.strip does."""
    return F.btrim(c, F.lit(_WS_CHARS))


def bullet_items(df: DataFrame, key: str, text: str) -> DataFrame:
    """List items per text: lines starting with -, * or •, or '1.'/'1)'; bold markers
    stripped; headers (#), prose and items ending with ':' dropped.
    Output (key, line_no, item_no, item)."""
    lines = df.select(key, F.posexplode(F.split(F.col(text), _LINE_SPLIT)).alias("line_no", "raw"))
    s = pystrip(F.col("raw"))
    first = F.substring(s, 1, 1)
    bullet = first.isin("-", "*", "•")
    numbered = first.rlike("^\\p{Nd}$") & (F.length(s) > 2) & F.substring(s, 2, 1).isin(")", ".")
    item = (F.when(bullet, pystrip(F.regexp_replace(s, "^[-*• ]+", "")))
            .when(numbered, pystrip(F.substring(s, 3, 1 << 30))))
    item = pystrip(F.regexp_replace(item, "^\\*+|\\*+$", ""))
    keep = (F.length(s) > 0) & ~s.startswith("#") & item.isNotNull() & (F.length(item) > 0) & ~item.endswith(":")
    out = lines.select(key, "line_no", item.alias("item"), keep.alias("keep")).where("keep")
    w = Window.partitionBy(key).orderBy("line_no")
    return out.select(key, "line_no", F.row_number().over(w).alias("item_no"), "item")


def line_stats(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_lines, n_nonblank) with Python splitlines semantics (no trailing empty line)."""
    parts = F.split(F.col(text), _LINE_SPLIT)
    n = F.size(parts) - F.when(F.col(text).rlike(f"({_LINE_SPLIT})$"), 1).otherwise(0)
    nonblank = F.size(F.filter(parts, lambda x: F.length(pystrip(x)) > 0))
    return df.select(key, F.when(F.length(text) == 0, 0).otherwise(n).alias("n_lines"),
                     nonblank.alias("n_nonblank"))


def plan_rows(texts: DataFrame, key: str, text: str, max_steps: int = MAX_PLAN_STEPS) -> DataFrame:
    """The first five items of each text as its plan; the default 4-step plan when a text
    has no items. Output (key, step_ord, step, is_default)."""
    items = bullet_items(texts, key, text).where(F.col("item_no") <= max_steps) \
        .select(key, F.col("item_no").cast("int").alias("step_ord"), F.col("item").alias("step"),
                F.lit(False).alias("is_default"))
    without = texts.select(key).join(items.select(key).distinct(), key, "left_anti")
    default = without.select(key, F.posexplode(F.array(*[F.lit(s) for s in DEFAULT_PLAN])).alias("p", "step")) \
        .select(key, (F.col("p") + 1).cast("int").alias("step_ord"), "step", F.lit(True).alias("is_default"))
    return items.unionByName(default)


_FENCE = "(?s)```(?:python)?\\s*(.*?)```"


def fenced_block(df: DataFrame, text: str, out: str = "code") -> DataFrame:
    """The first fenced block's body, else the whole text; stripped."""
    has = F.col(text).rlike(_FENCE)
    body = F.when(has, F.regexp_extract(text, _FENCE, 1)).otherwise(F.col(text))
    return df.withColumn("has_fence", F.coalesce(has, F.lit(False))).withColumn(out, pystrip(body))


FINDING_JSON = T.StructType([
    T.StructField("claim", T.StringType()), T.StructField("confidence", T.StringType()),
    T.StructField("method", T.StringType()), T.StructField("limitations", T.ArrayType(T.StringType()))])


def json_findings(df: DataFrame, text: str, max_limitations: int = MAX_LIMITATIONS,
                  output_chars: int = MAX_OUTPUT_CHARS) -> DataFrame:
    """T4: the first '{' .. last '}' span parsed as a finding; rows without a ``claim`` are no
    findings and go. Confidence not in high/medium/low becomes medium; ``max_limitations`` and
    ``output_chars`` bound the finding's lists and the text shown beside it."""
    span = F.regexp_extract(text, "(?s)(\\{.*\\})", 1)
    parsed = F.from_json(F.when(F.length(span) > 0, span), FINDING_JSON)
    conf = F.lower(parsed["confidence"])
    return df.select(
        "*", F.length(span).alias("json_chars"),
        parsed["claim"].alias("claim"),
        F.when(conf.isin("high", "medium", "low"), conf).otherwise(F.lit("medium")).alias("confidence"),
        parsed["method"].alias("method"),
        F.slice(F.coalesce(parsed["limitations"], F.array().cast("array<string>")), 1, max_limitations)
        .alias("limitations"),
        F.substring(F.col(text), 1, output_chars).alias("output")).where(F.length(F.col("claim")) > 0)


def _any_word(q: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(q, w))


def question_routes(questions: DataFrame, text: str, has_models: Column | bool,
                    has_charts: Column | bool, has_driver_finding: Column | bool,
                    has_trend_finding: Column | bool) -> DataFrame:
    """T5: route by ordered keyword substrings. Model and chart routes always answer (even
    with no artifact); driver and trend routes fall through when no such finding exists."""
    q = F.lower(F.col(text))
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    route = (F.when(_any_word(q, MODEL_WORDS), F.when(lit(has_models), F.lit("model")).otherwise(F.lit("model_none")))
             .when(_any_word(q, CHART_WORDS), F.when(lit(has_charts), F.lit("chart")).otherwise(F.lit("chart_none")))
             .when(_any_word(q, DRIVER_WORDS) & lit(has_driver_finding), F.lit("driver"))
             .when(_any_word(q, TREND_WORDS) & lit(has_trend_finding), F.lit("trend"))
             .otherwise(F.lit("lead")))
    return questions.withColumn("route", route)


def question_answers(routed: DataFrame, findings: DataFrame, model_answer: str | None,
                     chart_answer: str | None) -> DataFrame:
    """T5 answers: join each routed question to the first matching finding (one row per route,
    so the lookup table is tiny and broadcast)."""
    low = F.lower(F.col("claim"))
    pick = findings.agg(
        F.min_by(F.struct("claim", "confidence", F.array_join("limitations", "; ").alias("lims")), "ord").alias("lead"),
        F.min_by(F.struct("claim", "confidence", F.array_join("limitations", "; ").alias("lims")),
                 F.when(low.contains("driver"), F.col("ord"))).alias("driver"),
        F.min_by(F.struct("claim", "confidence", F.array_join("limitations", "; ").alias("lims")),
                 F.when(low.contains("over time"), F.col("ord"))).alias("trend"))
    answers = pick.select(F.explode(F.array(
        F.struct(F.lit("lead").alias("route"), F.concat(F.lit("Based on the analysis: "), F.coalesce(F.col("lead.claim"), F.lit(NO_FINDINGS)),
                                                        F.lit(" (confidence: "), F.coalesce(F.col("lead.confidence"), F.lit("n/a")), F.lit(")"))
                 .alias("answer")),
        F.struct(F.lit("driver").alias("route"), F.concat(F.col("driver.claim"), F.lit(" (confidence: "),
                                                          F.col("driver.confidence"), F.lit("). Caveat: "),
                                                          F.col("driver.lims")).alias("answer")),
        F.struct(F.lit("trend").alias("route"), F.concat(F.col("trend.claim"), F.lit(" (confidence: "),
                                                         F.col("trend.confidence"), F.lit(")")).alias("answer")),
        F.struct(F.lit("model").alias("route"), F.lit(model_answer).alias("answer")),
        F.struct(F.lit("model_none").alias("route"), F.lit(
            "No model has been trained yet (Part 1 / Modeler runs in a later milestone).").alias("answer")),
        F.struct(F.lit("chart").alias("route"), F.lit(chart_answer).alias("answer")),
        F.struct(F.lit("chart_none").alias("route"), F.lit("No dashboard has been built yet.").alias("answer")),
    )).alias("a")).select("a.*")
    return routed.join(F.broadcast(answers), "route", "left")  # 7 rows


def chat_window(conv: DataFrame, key: str = "conv_id", turn: str = "turn", n: int = CHAT_TURNS,
                salts: int = 64) -> DataFrame:
    """The last ``n`` turns of every conversation, exact and skew-safe (two-stage top-n)."""
    salted = conv.withColumn("_salt", F.pmod(F.xxhash64(F.col(turn)), F.lit(salts)))
    w1 = Window.partitionBy(key, "_salt").orderBy(F.desc(turn))
    stage1 = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= n).drop("_r1", "_salt")
    w2 = Window.partitionBy(key).orderBy(F.desc(turn))
    return stage1.withColumn("recent_rank", F.row_number().over(w2)).where(F.col("recent_rank") <= n)


def chat_last_user(conv: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
                   text: str = "text") -> DataFrame:
    """Latest user turn per conversation (max_by aggregates map-side: skew-safe)."""
    return conv.where(F.col(role) == "user").groupBy(key).agg(
        F.max(turn).alias("last_user_turn"), F.max_by(text, turn).alias("last_user_text"))
