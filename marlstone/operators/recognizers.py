"""Recognition of Philippine personal and payment identifiers, as one column over a text column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import around, finditer, merged, tail_group, unclaimed

ENTITY = "array<struct<type:string,start:int,end:int,text:string,score:double,validated:boolean,boost:double,reasons:array<string>>>"

# The forms of the identifiers and the words that must stand near them.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
IBAN = r"\bPH\d{2}[A-Z]{3}\d{10,18}\b"
MOBILE = r"(?<![\d+])(?:\+?63[\s\-]?|0)9\d{2}[\s\-]?\d{3}[\s\-]?\d{4}(?![\d])"
SSS = r"(?<![\d-])(?:\d{2}-\d{7}-\d|\d{5}-\d{5}|\d{4}-\d{6}|\d{3}-\d{2}-\d{4}|\d{2}-\d{3}-\d{4}|\d{3} \d{3} \d{3}|\d{9}(?![\d-]))(?![\d-])"
TIN = r"(?<![\d-])(?:\d{3}-\d{3}-\d{3}(?:-\d{1,4})?|\d{9}(?:-\d{1,4})?)(?![\d-])"
PAN = r"(?<![\d])(?:\d[ \-]?){12,18}\d(?![\d])"
CVV = r"(?iu)\b(?:cvv|cvc|cvv2|security\s+code|card\s+verification)\b\s*[:=#]?\s*(\d{3,4})\b"
ACCOUNT = r"(?iu)(?:account\s*(?:no|number|#)?|acct\s*(?:no|number)?|a/c\s*(?:no)?|kas account|account)\s*[:.#-]?\s*([0-9][0-9\-\s]{5,20}[0-9])"
REMITTANCE = r"(?iu)(?:cebuana(?:\s+lhuillier)?|western\s+union|\bwu\b|palawan(?:'s)?\s+express|moneygram|remittance|padala)\s*(?:ref(?:erence)?|control\s*number|ctr|for)?\s*[:#-]?\s*([A-Z0-9][A-Z0-9\-]{4,24})"
PHILSYS = r"\b\d{4}-\d{4}-\d{4}-\d{4}\b"
PASSPORT = r"\b[A-Z]\d{7}[A-Z]\b|\b[A-Z]{2}\d{7}[A-Z]?\b"
BIRTH = r"(?iu)\b(?:DOB|D\.O\.B\.?|born|birthdate)?\s*[:\-]?\s*((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4}|\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})\b"
SALARY = r"(?iu)(?:₱|PHP|P|PhP)\s?([\d,]{4,}(?:\.\d{2})?)\s*(?:k\b|thousand|per\s+month|monthly|mo\b|a\s+month|annually|/mo|/month)?|(?:monthly\s+salary|salary|basic\s+pay|compensation)\s*(?:is|:|=)?\s*(?:₱|PHP|P)?\s?([\d,]{4,}(?:\.\d{2})?)"
SALARY_LEAD = r"(?iu)^((?:₱|PHP|P|PhP)\s?)[\d,]{4,}"
TOKEN = r"\[[A-Z]{2,10}-[0-9A-F]{4,}\]"
WALLET_NEAR = r"(?iu)\b(?:gcash|gc\s?cash|maya|palawan\s?express|wallet|e-?wallet|paymaya|metrobank\s?wallet|bdminfo|bdo\s?pay|instapay)\b"
SSS_NEAR = r"(?iu)\b(?:sss|social\s+security)\b"
TIN_NEAR = r"(?iu)\b(?:tin|tax\s*id(?:entification)?(?:\s*number)?)\b"
CARD_NEAR = r"(?iu)\b(?:card|credit|debit|mastercard|master|visa|gcash|bdo|gcash\s+card|pan|exp(?:iry)?|magstripe|credit\s*card)\b"
ORDER_NEAR = r"(?iu)\b(?:invoice|inv|order|ref|reference|receipt|or#|transaction|txn|terminal|merchant|acct\s*ending|batch|journal|document)\b"
BIRTH_WORD = r"(?iu)\b(?:DOB|D\.O\.B|born|birthdate|birth\s*date|date\s+of\s+birth)\b"
SALARY_NEAR = r"(?iu)\b(salary|payroll|pay\s*roll|basic\s+pay|net\s+pay|gross\s+pay|compensation|remuneration|per\s+month|monthly|annual|\/\s*mo\b|monthly\s+salary|depositary|employer)\b"
NEAR, SALARY_PAD = 60, 40
#: Of the types that are found, the one that is not redacted by itself.
LOW_RISK = ("PERSON",)


@dataclass(frozen=True)
class Found:
    """How a match becomes an entity: all columns are over one span."""

    type: Column
    score: Column
    validated: Column
    boost: Column


def _entities(spans: Column, how) -> Column:
    def one(x: Column) -> Column:
        f = how(x)
        return F.struct(f.type.alias("type"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), f.score.cast("double").alias("score"), f.validated.alias("validated"), f.boost.cast("double").alias("boost"), _reasons(f).alias("reasons"))

    return F.transform(spans, one)


def _reasons(f: Found) -> Column:
    """Why a span counts: its form, what was checked, and words near it."""
    said = F.array(F.concat(F.lit("form:"), f.type), F.when(f.validated, F.lit("valid")), F.when(f.boost.cast("double") > 0, F.lit("words near")))
    return F.array_sort(F.array_compact(said))


def _plain(kind: str, score: float, boost: float = 0.0):
    return lambda x: Found(F.lit(kind), F.lit(score), F.lit(True), F.lit(boost))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def luhn_ok(c: Column) -> Column:
    d = digits(c)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def normal_mobile(c: Column) -> Column:
    """The number as +63 and ten digits, or null."""
    d = digits(c)
    return (
        F.when((F.length(d) == 12) & d.startswith("639"), F.concat(F.lit("+"), d))
        .when((F.length(d) == 11) & d.startswith("09"), F.concat(F.lit("+63"), F.substring(d, 2, 10)))
        .when((F.length(d) == 10) & d.startswith("9"), F.concat(F.lit("+63"), d))
    )


def mask_tokens(text: Column) -> Column:
    """``text`` with redaction tokens blanked; all offsets stay."""
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    parts = F.transform(F.arrays_zip(F.split(text, TOKEN, -1).alias("b"), found.alias("m")), lambda x: F.concat(x["b"], F.repeat(F.lit(" "), F.coalesce(F.length(x["m"]), F.lit(0)))))
    return F.when(F.size(found) > 0, F.concat_ws("", parts)).otherwise(text)


def steps(text_col: str, out: str) -> list[dict[str, Column]]:
    """The columns that recognition adds, in stages that build on each other; names with a leading __r_ are interim."""
    p = "__r_"
    h, hd = F.col(f"{p}h"), F.col(f"{p}d")
    near = lambda x, pattern, pad=NEAR: around(h, x, pad).rlike(pattern)
    stages = [{f"{p}h": F.coalesce(mask_tokens(F.col(text_col)), F.lit(""))}, {f"{p}d": F.when(h.rlike("[0-9]"), h).otherwise(F.lit(""))}]  # most patterns need a digit
    found = {f"{p}email": finditer(F.when(h.contains("@"), h).otherwise(F.lit("")), EMAIL)}
    found |= {p + name: finditer(hd, pattern) for name, pattern in (("iban", IBAN), ("mobile", MOBILE), ("sss", SSS), ("tin", TIN), ("pan", PAN), ("cvv", CVV))}
    found |= {f"{p}account": finditer(hd, ACCOUNT), f"{p}remit": finditer(h, REMITTANCE), f"{p}philsys": finditer(hd, PHILSYS), f"{p}passport": finditer(hd, PASSPORT), f"{p}birth": finditer(hd, BIRTH), f"{p}salary": finditer(h, SALARY)}
    stages.append(found)
    stages.append({f"{p}claimed": F.concat(*(F.col(p + c) for c in ("email", "iban", "mobile"))), f"{p}cvv": F.transform(f"{p}cvv", lambda x: tail_group(x, CVV))})
    claims = (
        ("sss", lambda x: F.length(digits(x["text"])).isin(9, 10) & (x["text"].contains("-") | near(x, SSS_NEAR))),
        ("tin", lambda x: F.length(digits(x["text"])).between(9, 13) & (x["text"].contains("-") | near(x, TIN_NEAR))),
        ("pan", lambda x: luhn_ok(x["text"]) | (~near(x, ORDER_NEAR) & near(x, CARD_NEAR))),
        ("cvv", lambda x: F.lit(True)),
    )
    before = [F.col(f"{p}claimed")]
    for name, keep in claims:
        spans = F.col(p + name)
        for claimed in before:
            spans = unclaimed(spans, claimed)
        stages.append({p + name: F.filter(spans, keep)})
        before.append(F.col(p + name))

    def mobile(x: Column) -> Found:
        wallet = near(x, WALLET_NEAR)
        return Found(F.when(wallet, "GCASH_MOBILE").otherwise("PH_MOBILE"), F.when(wallet, 0.96).otherwise(0.95), normal_mobile(x["text"]).isNotNull(), F.when(wallet, 0.05).otherwise(0.0))

    def pan(x: Column) -> Found:
        ok = luhn_ok(x["text"])
        return Found(F.lit("CARD_PAN"), F.when(ok, 0.99).otherwise(0.60), ok, F.when(near(x, CARD_NEAR), 0.05).otherwise(0.0))

    lead = lambda x: F.length(F.regexp_extract(x["text"], SALARY_LEAD, 1))
    amount = lambda x, g: F.regexp_extract(x["text"], SALARY, g)
    salary = F.filter(f"{p}salary", lambda x: near(x, SALARY_NEAR, SALARY_PAD))
    first = lambda x: F.struct((x["start"] + lead(x)).alias("start"), (x["start"] + lead(x) + F.length(amount(x, 1))).alias("end"), amount(x, 1).alias("text"))
    second = lambda x: F.struct((x["end"] - F.length(amount(x, 2))).alias("start"), x["end"].alias("end"), amount(x, 2).alias("text"))
    salaries = F.transform(salary, lambda x: F.when(amount(x, 1) != "", first(x)).otherwise(second(x)))
    parts = [
        _entities(F.col(f"{p}email"), _plain("EMAIL", 0.99)),
        _entities(F.col(f"{p}iban"), _plain("PH_IBAN", 0.95)),
        _entities(F.col(f"{p}mobile"), mobile),
        _entities(F.col(f"{p}sss"), lambda x: Found(F.lit("PH_SSS"), F.lit(0.97), F.lit(True), F.when(near(x, SSS_NEAR), 0.05).otherwise(0.0))),
        _entities(F.col(f"{p}tin"), lambda x: Found(F.lit("PH_TIN"), F.when(near(x, TIN_NEAR), 0.96).otherwise(0.92), F.lit(True), F.when(near(x, TIN_NEAR), 0.05).otherwise(0.0))),
        _entities(F.col(f"{p}pan"), pan),
        _entities(F.col(f"{p}cvv"), _plain("CARD_CVV", 0.95, 0.05)),
        _entities(F.transform(f"{p}account", lambda x: tail_group(x, ACCOUNT)), _plain("BANK_ACCOUNT", 0.85, 0.05)),
        _entities(F.transform(f"{p}remit", lambda x: tail_group(x, REMITTANCE)), _plain("REMITTANCE_REF", 0.85, 0.05)),
        _entities(F.col(f"{p}philsys"), _plain("PHILSYS_ID", 0.94)),
        _entities(F.filter(f"{p}passport", lambda x: F.lower(around(h, x, NEAR)).contains("passport")), _plain("PASSPORT", 0.85, 0.05)),
        _entities(F.transform(F.filter(f"{p}birth", lambda x: x["text"].rlike(BIRTH_WORD)), lambda x: tail_group(x, BIRTH)), _plain("DATE_OF_BIRTH", 0.90, 0.05)),
        _entities(salaries, _plain("SALARY", 0.85, 0.05)),
    ]
    return [*stages, {out: F.concat(*(x.cast(ENTITY) for x in parts))}]


def applied(df: DataFrame, stages: list[dict[str, Column]]) -> DataFrame:
    for stage in stages:
        df = df.withColumns(stage)
    return df.drop(*{name for stage in stages for name in stage if name.startswith("__r_")})


def detect(df: DataFrame, text_col: str = "text", out: str = "entities") -> DataFrame:
    """``df`` with the entities of a text column, before spans that meet are resolved.

    Exact formats claim their spans first; social security, tax and card numbers look only at what is unclaimed;
    labelled formats neither ask nor claim. A null text has no entities.
    """
    return applied(df, steps(text_col, out))


def resolved(entities: Column) -> Column:
    """Confidence from validation, score and context, then spans that meet merged."""
    weigh = lambda x: x.withField("score", F.bround(F.least(0.45 * F.when(x["validated"], 1.0).otherwise(0.6) + 0.35 * x["score"] + 0.20 * x["boost"], F.lit(0.99)), 3))
    return merged(F.transform(entities, weigh))
