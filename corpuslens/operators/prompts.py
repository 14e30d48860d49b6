"""Requests to a labelling model: codebook prompts, examples drawn per request, request bodies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import label_code, parse_labels, strip

_NOTHING = ("", "nan", "N/A", "None")
# fixed values: signs before a label's criteria and examples, and the frames of a sentence with context
CRITERIA = (("inclusion_criteria", "+"), ("exclusion_criteria", "-"), ("boundary_test", "⚖"))
EXAMPLES = (("Fewshot_v1", "[例1]"), ("Fewshot_v2", "[例2]"), ("Fewshot_contrast", "[對比]"))
INSTRUCTION = "請標註以下文本：\n\n"
BEFORE, TARGET, AFTER = "【前文（僅供語境參考，不標註）】", "【本句（請標註）】", "【後文（僅供語境參考，不標註）】"


def user_text(sentence: Column, prev: Column, next_: Column, instruction: str = INSTRUCTION) -> Column:
    """The message about one sentence: with its context where there is any, else after an instruction,
    which may be empty."""
    s, p, n = (strip(F.coalesce(c.cast("string"), F.lit(""))) for c in (sentence, prev, next_))
    framed = F.concat(F.lit(BEFORE), p, F.lit("\n" + TARGET), s, F.lit("\n" + AFTER), n)
    return F.when((p == "") & (n == ""), F.concat(F.lit(instruction), s)).otherwise(framed)


def _line(c: str, sign: str, columns: Sequence[str]) -> Column:
    if c not in columns:
        return F.lit("")
    text = strip(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return F.when(text.isin(*_NOTHING), "").otherwise(F.concat(F.lit(f" {sign} "), text, F.lit("\n")))


def codebook_text(guide: DataFrame, order: str, examples: DataFrame | None = None) -> DataFrame:
    """One row (codebook, labels): a codebook's definitions, criteria and examples as prompt text, and
    its label ids. guide(label_id, label_cn, core_definition, ...); examples(label_id, ...), of which
    a label's first by ``order`` counts. A codebook is a few dozen rows."""
    head = F.concat(F.lit("["), "label_id", F.lit("_"), F.coalesce("label_cn", F.lit("")), F.lit("] 定義:"), F.coalesce("core_definition", F.lit("")), F.lit("\n"))
    rows = guide.withColumn("_text", F.concat(head, *[_line(c, sign, guide.columns) for c, sign in CRITERIA]))
    if examples is not None:
        shown = examples.withColumn("_examples", F.concat(*[_line(c, sign, examples.columns) for c, sign in EXAMPLES]))
        shown = shown.groupBy("label_id").agg(F.min_by("_examples", order).alias("_examples"))
        rows = rows.join(F.broadcast(shown), "label_id", "left").withColumn("_text", F.concat("_text", F.coalesce("_examples", F.lit(""))))
    listed = rows.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "label_id", "_text"))).alias("r"))
    return listed.select(F.array_join(F.transform("r", lambda x: x["_text"]), "").alias("codebook"), F.array_join(F.transform("r", lambda x: x["label_id"]), ", ").alias("labels"))


def system_prompt(codebook: DataFrame, head: str, rules: str, cases: Column | None, tail: str) -> Column:
    """The system message round a codebook's text: head, codebook, rules, drawn cases, and the tail with
    {labels} in the place of the legal labels. Refers to the columns of ``codebook_text``."""
    parts = [F.lit(head), F.col("codebook"), F.lit(rules), F.coalesce(cases, F.lit("")) if cases is not None else F.lit("")]
    return F.concat(*parts, F.replace(F.lit(tail), F.lit("{labels}"), F.col("labels")))


def hard_pool(pool: DataFrame, layer: str, need: Sequence[str] = ("layer", "stratum", "sentence", "gold_L1")) -> DataFrame | None:
    """The cases of a layer or of both; with gold_L2 where the layer asks for it. None where the pool
    lacks a column, which switches drawing off."""
    if not set(need) <= set(pool.columns):
        return None
    rows = pool.where(F.col("layer").isin(layer, "BOTH"))
    return rows.where(strip(F.coalesce("gold_L2", F.lit(""))) != "") if layer == "L2" and "gold_L2" in pool.columns else rows


def draw_cases(requests: DataFrame, pool: DataFrame, request_id: str, n: int, seed: str, key: str = "sentence", stratum: str = "stratum", most: int = 10_000) -> DataFrame:
    """requests with ``cases``, n rows of the pool for each, balanced over its strata.

    Every request has a shuffle of its own, by hashes of seed, id and case: round after round one
    case of each stratum, and from the start again where the pool is smaller than n. The pool is sent
    to all tasks, so it may have ``most`` rows at most.
    """
    columns = pool.columns
    if pool.limit(most + 1).count() > most:
        raise ValueError(f"a pool of cases has {most} rows at most")
    group = F.when(strip(F.coalesce(stratum, F.lit(""))) == "", "_other").otherwise(strip(F.col(stratum)))
    one = pool.agg(F.sort_array(F.collect_list(F.struct(group.alias("_group"), *columns))).alias("_pool"))
    hashed = lambda salt, c: F.md5(F.concat(F.lit(seed + ":"), F.col(request_id).cast("string"), F.lit(salt), c.cast("string")).cast("binary"))
    marked = F.transform("_pool", lambda r: F.struct(hashed(":g:", r["_group"]).alias("g"), hashed(":c:", F.coalesce(r[key], F.lit(""))).alias("h"), r.alias("r")))
    rows = requests.crossJoin(F.broadcast(one)).withColumn("_marked", F.array_sort(marked))  # one row
    ranked = F.transform("_marked", lambda x, i: F.struct((i - F.array_position(F.transform("_marked", lambda y: y["g"]), x["g"]) + 1).alias("turn"), x["g"].alias("g"), x["r"].alias("r")))
    rows = rows.withColumn("_ranked", F.array_sort(ranked))
    picked = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at("_ranked", (i % F.size("_ranked") + 1).cast("int"))["r"])
    none = F.array().cast(rows.select(picked.alias("p")).schema["p"].dataType)
    return rows.withColumn("cases", F.when((F.size("_pool") > 0) & F.lit(n > 0), picked).otherwise(none)).drop("_pool", "_marked", "_ranked")


def cases_text(cases: Column, layer: str, head: str, doubt: str) -> Column:
    """Drawn cases as prompt text: sentence, label as it should be answered, and a note."""

    def one(r: Column, i: Column) -> Column:
        code = label_code(strip(r["gold_L1"]))
        said = strip(F.coalesce(r[f"gold_{layer}_cot"], F.lit("")))
        said = F.when(said == "", doubt).otherwise(said)
        if layer == "L1":
            answer = F.to_json(F.struct(said.alias("L1_cot"), code.alias("L1")))
            known = F.lit("")
        else:
            answer = F.to_json(F.struct(said.alias("L2_cot"), parse_labels(r["gold_L2"]).alias("L2")))
            known = F.concat(F.lit("已知L1："), code, F.lit("\n"))
        # a JSON array of one text, without its brackets
        quoted = F.regexp_replace(F.to_json(F.array(strip(r["sentence"]))), r"^\[|\]$", "")
        note = strip(F.coalesce(r["notes"], F.lit("")))
        noted = F.when(note == "", "").otherwise(F.concat(F.lit("類型："), note, F.lit("\n")))
        return F.concat(F.format_string(f"[HC-{layer}-%d] ", i + 1), known, F.lit("文本："), quoted, F.lit("\n參考輸出："), answer, F.lit("\n"), noted, F.lit("\n"))

    return F.when(F.size(cases) > 0, F.concat(F.lit(head), F.array_join(F.transform(cases, one), ""))).otherwise("")


def request_body(custom_id: Column, model: str, system: Column, user: Column, temperature: float, json_object: bool = True) -> list[Column]:
    """The columns of one request line."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    body = [F.lit(model).alias("model"), F.array(message("system", system), message("user", user)).alias("messages"), F.lit(temperature).alias("temperature")]
    if json_object:
        body.append(F.struct(F.lit("json_object").alias("type")).alias("response_format"))
    return [custom_id.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), F.struct(*body).alias("body")]


def paired_requests(rows: DataFrame, sentence: str, key: Column, model: str, system: dict[str, Column], temperatures: dict[str, float], prev: str = "prev", next_: str = "next") -> tuple[DataFrame, dict[str, DataFrame]]:
    """(reference rows, requests by layer): one custom_id a row with a sentence, shared by its requests
    of all layers and by the reference. The id comes from the key, so a repeated run asks the same."""
    shown = rows.where(strip(F.coalesce(F.col(sentence), F.lit(""))) != "")
    shown = shown.withColumn("custom_id", F.concat(F.lit("req_"), F.md5(key.cast("string").cast("binary"))))
    user = user_text(F.col(sentence), F.col(prev) if prev in rows.columns else F.lit(""), F.col(next_) if next_ in rows.columns else F.lit(""))
    asked = {layer: shown.select(*request_body(F.col("custom_id"), model, system[layer], user, temperatures[layer])) for layer in system}
    return shown, asked


def request_parts(requests: DataFrame, key: str, per_part: int = 50) -> DataFrame:
    """requests with ``part``, from 0, of per_part rows in the key's order. Ranks are taken within
    ranges of the key and lifted by the ranges' sizes, so no window spans the table."""
    from .order import numbered

    return numbered(requests, [key], "_n").withColumn("part", F.floor((F.col("_n") - 1) / per_part)).drop("_n")


def replicated(requests: DataFrame, times: int = 3) -> DataFrame:
    """Every request ``times`` times, numbered by ``replicate`` from 0."""
    return requests.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
