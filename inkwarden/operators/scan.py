"""Scanning: texts or files to findings, reports and verdicts.

``scan_files`` runs the whole inspection (extraction, decodings, all rules) in
one Arrow function per batch. ``native_hits`` is the same catalogue as literal
``rlike`` columns over plain text, for tables that need no extraction: each
pattern is compiled once per task and runs where its necessary literals are, which
one pass over the text finds for all patterns; the hits of all rules are one array of the row. Scores and verdicts are
made of that array where it is, without a shuffle; only findings explode it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import inspect as ins
from ..functions import text as tx
from ..functions.prefilter import necessary_literals, shortest, tree_pattern
from ..functions.rules import RULES, VERSION, Rule
from ..plans import policy as pl
from ..sources.extract import Reading, Refused, extract
from ..sources.scratch import spread

FINDING = "struct<rule_id:string,title:string,severity:string,category:string,evidence:string,location:string,layer:string,line:int,encoding:string>"
REPORT = f"sha256 string, size_bytes long, format string, characters long, segments int, risk_score int, severity string, analysis_complete boolean, failure_code string, findings array<{FINDING}>"
_FIELDS = ["sha256", "size_bytes", "format", "characters", "segments", "risk_score", "severity", "analysis_complete", "failure_code", "findings"]


def scan_files(files: DataFrame, id_col: str = "path", content_col: str = "content", name_col: str = "filename", rules: tuple[Rule, ...] = RULES, policy: dict = pl.POLICY, reading: Reading = Reading()) -> DataFrame:
    """Reports: the id, REPORT, rules_version, policy_version, status and verdict. Null content is an oversized file."""
    kind = files.schema[id_col].dataType.simpleString()
    rows = files.select(F.col(id_col).alias("id"), F.col(content_col).cast("binary").alias("data"), F.col(name_col).alias("name"))
    rows = rows if rows.isStreaming else spread(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            reports = [ins.inspected(bytes(d), n or "", rules, reading) if d is not None else _oversized() for d, n in zip(batch["data"], batch["name"], strict=True)]
            yield pd.concat([batch["id"].reset_index(drop=True), pd.DataFrame(reports, columns=_FIELDS)], axis=1)

    return decided(rows.mapInPandas(run, f"id {kind}, {REPORT}"), policy)


def _oversized() -> dict:
    failure = {"rule_id": "INPUT_SIZE_LIMIT", "title": "File exceeds the size limit", "severity": "HIGH", "category": "ANALYSIS_FAILURE", "evidence": "", "location": "file", "layer": "METADATA", "line": None, "encoding": None}
    return {"sha256": None, "size_bytes": None, "format": "unknown", "characters": 0, "segments": 0, "risk_score": 100, "severity": "HIGH", "analysis_complete": False, "failure_code": "INPUT_SIZE_LIMIT", "findings": [failure]}


def segments_of(files: DataFrame, id_col: str = "path", content_col: str = "content", name_col: str = "filename", reading: Reading = Reading()) -> DataFrame:
    """id, text, layer and location of each segment of each file; a file that is refused has one row with its ``error``."""
    kind = files.schema[id_col].dataType.simpleString()
    rows = spread(files.select(F.col(id_col).alias("id"), F.col(content_col).cast("binary").alias("data"), F.col(name_col).alias("name")))

    def of(data: bytes | None, name: str | None) -> list[tuple]:
        try:
            return [(*s, None) for s in extract(bytes(data or b""), name or "", reading).segments]
        except Refused as e:
            return [(None, None, None, e.code)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, *s) for i, d, n in zip(b["id"], b["data"], b["name"], strict=True) for s in of(d, n)], columns=["id", "text", "layer", "location", "error"])

    return rows.mapInPandas(run, f"id {kind}, text string, layer string, location string, error string")


def variants_of(rows: DataFrame, id_col: str, text_col: str, since: Column | None = None) -> DataFrame:
    """id, encoding, decoded: what each text itself may stand for, one layer deep, each once; passages that begin before the character ``since`` stay as they are."""
    kind = rows.schema[id_col].dataType.simpleString()

    def of(text: str | None, since: int) -> list[tuple]:
        try:
            return list(dict.fromkeys((name, found) for found, name in tx.decodings(text or "", since)))
        except (tx.DecodingLimit, UnicodeDecodeError) as e:
            return [(type(e).__name__, None)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, *v) for i, t, s in b.itertuples(index=False, name=None) for v in of(t, s)], columns=["id", "encoding", "decoded"])

    return spread(rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.lit(0) if since is None else since).alias("since"))).mapInPandas(run, f"id {kind}, encoding string, decoded string")


def decided(reports: DataFrame, policy: dict = pl.POLICY) -> DataFrame:
    """Adds failure_kind, status and verdict to reports with findings, risk_score and analysis_complete."""
    failed = F.exists("findings", lambda f: (f["category"] == "ANALYSIS_FAILURE") | (f["rule_id"] == "SCAN_INCOMPLETE"))
    incomplete = failed | ~F.coalesce(F.col("analysis_complete"), F.lit(True))
    damaged = F.coalesce(F.col("failure_kind") == "MALFORMED", F.lit(False)) | F.exists("findings", lambda f: f["rule_id"].isin(*pl.DAMAGE))
    convicting = F.exists("findings", lambda f: pl.is_convicting(f["severity"], f["category"]))
    out = reports.withColumn("failure_kind", pl.failure_kind(F.col("failure_code"))).withColumn("_first", F.when(incomplete, "BLOCKED").otherwise(pl.status_of(F.col("risk_score"), policy)))
    out = out.withColumn("verdict", pl.verdict_of(incomplete, damaged, convicting, F.size("findings") > 0, F.col("_first")))
    out = out.withColumn("status", F.when((F.col("verdict") != "VALID") & (F.col("_first") == "ALLOWED"), "FLAGGED").otherwise(F.col("_first"))).drop("_first")
    return out.withColumn("rules_version", F.lit(VERSION)).withColumn("policy_version", F.lit(policy["version"]))


def failures(files: DataFrame, id_col: str, code: Column, policy: dict = pl.POLICY) -> DataFrame:
    """Reports on files that were not inspected: BLOCKED, UNSCANNABLE, score 100, with ``code`` as the only finding."""
    text = lambda x: F.lit(x).cast("string")
    finding = F.struct(code.alias("rule_id"), text("File not inspected").alias("title"), text("HIGH").alias("severity"), text("ANALYSIS_FAILURE").alias("category"), text("").alias("evidence"), text("file").alias("location"), text("METADATA").alias("layer"), F.lit(None).cast("int").alias("line"), text(None).alias("encoding"))
    return files.select(
        F.col(id_col).alias("id"), text("").alias("sha256"), F.lit(100).alias("risk_score"), text("HIGH").alias("severity"), F.lit(False).alias("analysis_complete"), code.alias("failure_code"),
        F.array(finding).alias("findings"), text("BLOCKED").alias("status"), text("UNSCANNABLE").alias("verdict"), text("not-run").alias("rules_version"), F.lit(policy["version"]).alias("policy_version"),
    )


def findings_of(reports: DataFrame) -> DataFrame:
    return reports.select("id", F.explode("findings").alias("f")).select("id", "f.*")


def with_hits(rows: DataFrame, clean: Column, rules: tuple[Rule, ...] = RULES, languages: tuple[str, ...] | None = None, prefilter: bool = True) -> DataFrame:
    """``rows`` with ``hits``: a struct (rule_id, language, severity, category, score) for each rule and language that an already normalised text matches."""
    chosen = [(r, lang, p, necessary_literals(p) if prefilter else ()) for r in rules for lang, ps in r.patterns.items() if not languages or lang in languages for p in ps]
    short = shortest({w for *_, words in chosen for w in words})
    texts = spread(rows).withColumn("_clean", clean)
    if short:
        found = F.regexp_extract_all("_clean", F.lit(f"(?=({tree_pattern(sorted(set(short.values())))}))"), F.lit(1))
        texts = texts.withColumn("_words", F.array_distinct(found))
    # One expression text for the whole catalogue: built column by column, it is thousands of calls to the JVM.
    tests: dict[tuple[str, str], list[str]] = {}
    for r, lang, p, words in chosen:
        test = f"rlike(_clean, {_quoted(f'(?isU){p}')})"
        if words:
            test = f"(arrays_overlap(_words, array({', '.join(_quoted(w) for w in sorted({short[w] for w in words}))})) AND {test})"
        tests.setdefault((r.rule_id, lang), []).append(test)
    of = {r.rule_id: r for r in rules}
    hits = [
        f"CASE WHEN {' OR '.join(some)} THEN named_struct('rule_id', {_quoted(k)}, 'language', {_quoted(lang)}, 'severity', {_quoted(of[k].severity)}, 'category', {_quoted(of[k].category)}, 'score', {of[k].score}) END"
        for (k, lang), some in tests.items()
    ]
    return texts.withColumn("hits", F.expr(f"array_compact(array({', '.join(hits)}))")).drop("_clean", "_words")


def native_hits(rows: DataFrame, id_col: str, clean: Column, rules: tuple[Rule, ...] = RULES, languages: tuple[str, ...] | None = None, prefilter: bool = True) -> DataFrame:
    """id, rule_id, language, severity, category, score: the hits as rows."""
    texts = rows.select(F.col(id_col).alias("id"), clean.alias("_text"))
    return exploded(with_hits(texts, F.col("_text"), rules, languages, prefilter))


def exploded(rows: DataFrame) -> DataFrame:
    """id and the fields of each hit; the outer explode keeps the optimiser from testing the hits of a text a second time for whether there are any."""
    return rows.select("id", F.explode_outer("hits").alias("h")).filter("h IS NOT NULL").select("id", "h.*")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scored(rows: DataFrame, policy: dict = pl.POLICY) -> DataFrame:
    """``rows`` with ``hits`` as reports: a rule counts once, scores add up to 100; severity, n_rules, verdict and status."""
    found = F.array_distinct(F.transform("hits", lambda h: F.struct(h["rule_id"], h["severity"], h["category"], h["score"])))
    out = rows.withColumn("_found", found).drop("hits")
    total = F.aggregate("_found", F.lit(0), lambda a, h: a + h["score"])
    worst = F.coalesce(F.array_max(F.transform("_found", lambda h: pl.rank(h["severity"]))), F.lit(0))
    convicting = F.exists("_found", lambda h: pl.is_convicting(h["severity"], h["category"]))
    out = out.withColumn("risk_score", F.least(F.lit(100), total).cast("int")).withColumn("severity", pl.severity_of(worst)).withColumn("n_rules", F.size("_found").cast("long"))
    never = F.lit(False)
    out = out.withColumn("verdict", pl.verdict_of(never, never, convicting, F.col("n_rules") > 0, pl.status_of(F.col("risk_score"), policy)))
    return out.withColumn("status", pl.service_status(never, F.col("risk_score"), F.col("verdict"), policy)).drop("_found")


def first_findings(findings: DataFrame, order: Column) -> DataFrame:
    """The first of each (id, rule, location, encoding, layer) in discovery order."""
    w = Window.partitionBy("id", "rule_id", "location", "encoding", "layer").orderBy(order)
    return findings.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def decoded_tokens(rows: DataFrame, id_col: str, text: Column) -> DataFrame:
    """id, encoding, decoded: printable Base64 tokens and hex runs of a text, by built-in functions."""
    base64 = F.transform(F.regexp_extract_all(text, F.lit(tx.BASE64_TOKEN), F.lit(0)), lambda v: F.struct(F.lit("base64").alias("encoding"), v.alias("token")))
    hexes = F.transform(F.regexp_extract_all(text, F.lit(tx.HEX_RUN), F.lit(0)), lambda v: F.struct(F.lit("hex").alias("encoding"), F.regexp_replace(v, "^0x", "").alias("token")))
    found = rows.select(F.col(id_col).alias("id"), F.explode(F.concat(base64, hexes)).alias("t")).select("id", "t.encoding", "t.token")
    padded = F.concat(F.translate("token", "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length("token"), F.lit(4)).cast("int")))
    raw = F.when(F.col("encoding") == "hex", F.try_to_binary("token", F.lit("hex"))).otherwise(F.try_to_binary(padded, F.lit("base64")))
    out = found.withColumn("_raw", raw).filter(F.col("_raw").isNotNull() & F.is_valid_utf8(F.col("_raw").cast("string")))
    out = out.withColumn("decoded", F.col("_raw").cast("string")).drop("_raw", "token")
    unprintable = F.length("decoded") - F.length(F.regexp_replace("decoded", r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Cn}&&[^\s]]", ""))
    return out.filter((F.length("decoded") >= tx.PRINTABLE_LEAST) & ~F.col("decoded").contains("\x00") & (1 - unprintable / F.length("decoded") >= tx.PRINTABLE_SHARE))
