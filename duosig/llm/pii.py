"""Personal data by weak supervision: labelers vote, EM estimates their reliabilities, a span classifier learns from both. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared, spans

#: Kinds with a pattern of their own, whose matches always stay; then kinds that only the method finds.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "id", "account")
# Each begins where a run of its characters begins or where the match before ended: a match from within a run would also
# start at its beginning, and long runs without a match stay linear. Repeated groups are possessive, as Java recurses for others.
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MAY = {"email": r"@", "ip": r"\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Wider patterns, whose matches count only if the classifier says so: spelled-out addresses, addresses of version 6, national
#: numbers, identity numbers of three, two and four digits or of nine, and other numbers of 13 to 19 digits.
WIDE = [
    ("email", rf"(?<!{LOCAL}){LOCAL}{{1,64}}\x20?[\[(][Aa][Tt][\])]\x20?[A-Za-z0-9-]{{1,63}}(?:(?:\.|\x20?[\[(][Dd][Oo][Tt][\])]\x20?)[A-Za-z0-9-]{{1,63}}+)++", r"[\[(][Aa][Tt][\])]"),
    ("ip", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", r"[0-9A-Fa-f]:[0-9A-Fa-f]"),
    ("phone", r"(?<![0-9+(.-])(?<![0-9]\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])", r"[0-9]{3}[.-][0-9]{4}"),
    ("id", r"(?<![0-9.,-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{9})(?![0-9-])(?![.,][0-9])", r"[0-9]{4}"),
    ("account", r"(?<![0-9.,-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![0-9])(?![.,-][0-9])", r"[0-9][\x20-]?[0-9]"),
]
#: Gazetteers. Top-level domains: these and all countries' codes. Fixed values.
DOMAINS = "com org net edu gov mil int info biz name pro aero coop museum jobs mobi travel tel cat post io dev app online site shop store tech xyz eu uk".split()
#: Country calling codes of one, two and three digits begin like this. Fixed values.
CALLING = "1|7|2[07]|3[0123469]|4[013456789]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689][0-9]|3[578][0-9]|42[013]|5[09][0-9]|6[7-9][0-9]|8[0578][0-9]|9[679][0-9]"
#: Issuer ranges of payment cards. Fixed values.
ISSUERS = "4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|3(?:0[0-5]|095|[689])|6(?:011|4[4-9]|5)|35(?:2[89]|[3-8])|62|50|5[6-9]|6[37]"
#: Cue words of the context labeler in English, German, French and Spanish.
CUES = {
    "email": "e-?mail|mail|contact|write|reach|reply|kontakt|schreib\\w*|courriel|écri\\w*|correo|escrib\\w*",
    "ip": "ip|host|server|address|login|client|logged|from|adresse|serveur|servidor|rechner",
    "card": "card|visa|mastercard|amex|credit|payment|debit|karte|kreditkarte|carte|paiement|tarjeta|pago",
    "phone": "tel|telephone|phone|call|mobile|cell|fax|contact|telefon|anruf|rufnummer|téléphone|appel\\w*|teléfono|llam\\w*|móvil",
    "id": "ssn|social|security|id|passport|licen[cs]e|tax|ausweis\\w*|steuer\\w*|sécurité|passeport|dni|nie|pasaporte",
    "account": "account|acct|card|iban|bank|konto\\w*|karte|compte|banque|carte|cuenta|banco|tarjeta",
}
AGAINST = "version|release|isbn|issn|doi|order|invoice|serial|build|part|sku|page|chapter|article|rechnung|bestell\\w*|facture|commande|factura|pedido|id="
BEFORE, AFTER = 32, 4
VOTES = ("pattern", "gazetteer", "context", "layout", "company")
ROUNDS = 60
#: Spans that smooth each feature of the classifier.
SMOOTH = 2.0
#: Values of the feature of the word before a span.
WORD_BUCKETS = 64


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    digit = F.transform(F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1))), lambda i: F.substring(number, -i, F.lit(1)).cast("int") * (2 - i % 2))
    return F.aggregate(digit, F.lit(0), lambda total, d: total + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def distinct_digits(number: Column) -> Column:
    return F.size(F.array_distinct(F.split(number, "")))


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.concat(F.lit("0"), F.substring(p, -3, 3)).cast("int") <= 255))
    if kind == "card":
        return F.length(digits(value)).between(12, 19) & luhn(digits(value))
    return F.length(digits(value)).between(9, 15) if kind == "phone" else F.lit(True)


def _check(kind: str):
    return lambda s: _valid(kind, s["value"])


def _sign(yes: Column) -> Column:
    return F.when(yes, 1).otherwise(-1)


def _votes(kind: str, s: Column, strict: bool, domains: list[str]) -> list[Column]:
    """-1, 0 or 1 of the pattern, gazetteer, context and layout labelers.

    Pattern: the kind's own pattern and check; for other matches whether the digits look drawn or the number can have been
    given out. Gazetteer: top-level domains, calling codes, issuers, reserved addresses. Context: cue words before the
    span. Layout: whether the span stands by itself or sticks to letters and signs.
    """
    value, number = s["value"], digits(s["value"])
    area = F.substring(number, 1, 3)
    given_out = ~area.isin("000", "666") & ~area.startswith("9") & ~number.rlike("^.{3}00|0000$")
    pattern = {"id": _sign(given_out), "account": _sign(distinct_digits(number) >= 5)}.get(kind, F.lit(0))
    if kind == "email":
        gazetteer = _sign(F.lower(F.regexp_extract(value, "([A-Za-z0-9-]+)$", 1)).isin(domains))
    elif kind == "ip":
        gazetteer = _sign(~value.rlike(r"^(?:0|10|127|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|22[4-9]|2[3-5][0-9])\.|^(?:[Ff][CcDdEe]|0+:0+:)"))
    elif kind == "phone":
        gazetteer = _sign(number.rlike(f"^(?:{CALLING})") if strict else number.rlike("^[2-9]"))
    elif kind in ("card", "account"):
        gazetteer = _sign(number.rlike(f"^(?:{ISSUERS})")) if kind == "card" else F.when(number.rlike(f"^(?:{ISSUERS})"), 1).otherwise(0)
    else:
        gazetteer = F.lit(0)
    near = lambda words: s["before"].rlike(rf"(?iu)(?<![\p{{L}}])(?:{words})(?![\p{{L}}])")
    context = F.when(near(AGAINST), -1).when(near(CUES[kind]), 1).otherwise(0)
    sticks = s["before"].rlike(r"[\p{L}0-9_#=/\\-]$") | s["after"].rlike(r"^[\p{L}0-9_=/\\]")
    return [F.lit(1) if strict else pattern, gazetteer, context, _sign(~sticks)]


def _features(kind: str, s: Column) -> Column:
    """Features of the classifier, none of which is a vote: the span's shape, and what stands around it."""
    value, number = s["value"], digits(s["value"])
    head = F.lower(F.regexp_extract(s["before"], r"([\p{L}]+)[^\p{L}]*$", 1))
    sort = lambda c: F.when(c == "", "edge").when(c.rlike(r"\s"), "space").when(c.rlike(r"\p{L}"), "letter").when(c.rlike("[0-9]"), "digit").otherwise("sign")
    found = {
        "word": F.when(head == "", "none").otherwise(F.pmod(F.xxhash64(head), F.lit(WORD_BUCKETS)).cast("string")),
        "left": sort(F.right(s["before"], F.lit(1))), "right": sort(F.left(s["after"], F.lit(1))), "next": sort(F.substring(s["after"], 2, 1)),
        "digits": F.least(F.length(number), F.lit(20)).cast("string"), "kinds": distinct_digits(number).cast("string"),
        "first": F.when(number == "", "none").otherwise(F.left(number, F.lit(1))),
        "signs": F.concat_ws("", *[F.when(value.contains(x), x) for x in "@+([.- :"]),
        "length": F.least(F.floor(F.log2(F.length(value))), F.lit(8)).cast("string"),
    }
    return F.array(*[F.concat_ws("=", F.lit(f"{kind} {n}"), c) for n, c in found.items()])


def _described(kind: str, strict: bool, domains: list[str]):
    def seen(s: Column) -> Column:
        return F.struct(
            s["start"].alias("start"),
            F.lit(ALL_KINDS.index(kind)).alias("k"),
            s["stop"].alias("stop"),
            F.lit(kind).alias("kind"),
            s["value"].alias("value"),
            F.concat_ws(",", F.lit(kind), *[v.cast("string") for v in _votes(kind, s, strict, domains)]).alias("votes"),
            _features(kind, s).alias("features"),
        )

    return seen


def _up_to(listed: str, field: str, bound: str) -> str:
    """How many of the spans in column listed, which are apart and sorted, have a field at or below bound: by halves, as both ends rise from span to span."""
    middle = "(a.lo + a.hi) div 2"
    halve = f"if(a.lo >= a.hi, a, if({listed}[{middle}].{field} <= {bound}, struct({middle} + 1 as lo, a.hi as hi), struct(a.lo as lo, {middle} as hi)))"
    return f"aggregate(sequence(0, 1 + int(log2(1 + size({listed})))), struct(0L as lo, bigint(size({listed})) as hi), (a, _) -> {halve}, a -> a.lo)"


def _meeting(listed: str, span: str) -> str:
    """The spans in column listed that overlap span: a slice of it. Spans of one pattern are apart, so that all spans of a text together have few more of these than spans."""
    low = _up_to(listed, "stop", f"{span}.start")
    return f"slice({listed}, int({low}) + 1, greatest(0, int({_up_to(listed, 'start', f'{span}.stop - 1')} - {low})))"


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per row of docs: doc_id, n_<kind>, and base and wide spans with their votes and features; wide spans overlap no base span."""
    countries = docs.sparkSession.sparkContext._jvm.java.util.Locale.getISOCountries()
    domains = sorted({*DOMAINS, *(c.lower() for c in countries)})
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    sets = [(k, PATTERNS[k], MAY[k], True) for k in KINDS] + [(*w, False) for w in WIDE]
    parts = {}
    for i, (_, pattern, may, _) in enumerate(sets):
        parts[f"_m{i}"], parts[f"_p{i}"] = spans.find(F.col("_text"), pattern, F.col("_text").rlike(may))
    rows = rows.withColumns(parts)
    rows = rows.select("doc_id", *[spans.with_context(f"_m{i}", f"_p{i}", BEFORE, AFTER).alias(f"_s{i}") for i in range(len(sets))])
    made = []
    for i, (kind, _, _, strict) in enumerate(sets):
        column = F.filter(f"_s{i}", _check(kind)) if strict else F.col(f"_s{i}")
        made.append(F.transform(column, _described(kind, strict, domains)).alias(f"_c{i}"))
    rows = rows.select("doc_id", *made)
    n = len(KINDS)
    # Each pattern's spans are sorted and apart: a wide span looks up those of every base pattern around it.
    free = " and ".join(f"size({_meeting(f'_c{i}', 'w')}) = 0" for i in range(n))
    base = [F.col(f"_c{i}") for i in range(n)]
    held = F.size(F.concat(*base)) > 0
    clear = [F.when(held & (F.size(f"_c{i}") > 0), F.expr(f"filter(_c{i}, w -> {free})")).otherwise(F.col(f"_c{i}")) for i in range(n, len(sets))]
    rows = rows.select("doc_id", *[F.size(c).cast("long").alias(f"n_{k}") for c, k in zip(base, KINDS, strict=True)], F.concat(*base).alias("base"), F.concat(*clear).alias("wide"))
    # The company labeler: other spans in the document, of which at least one matches a kind's own pattern.
    company = F.when((F.size("base") > 0) & (F.size("base") + F.size("wide") > 1), ",1").otherwise(",0")
    vote = lambda s: s.withField("votes", F.concat(s["votes"], company))
    return rows.withColumns({c: F.array_sort(F.transform(c, vote)) for c in ("base", "wide")})


def reliabilities(patterns: dict[tuple, int], rounds: int = ROUNDS) -> tuple[dict[tuple, float], dict[tuple[str, str], float]]:
    """EM over the counts of vote patterns (kind, votes): the posterior of each pattern, and each labeler's reliability by kind.

    A label is personal data or not; a labeler votes rightly with its reliability or abstains with 0. Weak priors keep estimates inside (0, 1).
    """
    kinds = {p[0] for p in patterns}
    right = {(k, v): 0.8 for k in kinds for v in VOTES}
    share = dict.fromkeys(kinds, 0.5)
    posterior = dict.fromkeys(patterns, 0.5)
    for _ in range(rounds):
        for p in patterns:
            odds = math.log(share[p[0]] / (1 - share[p[0]]))
            for name, vote in zip(VOTES, p[1:], strict=True):
                odds += vote * math.log(right[p[0], name] / (1 - right[p[0], name]))
            posterior[p] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        for k in kinds:
            mine = [(p, n) for p, n in patterns.items() if p[0] == k]
            share[k] = (1 + sum(n * posterior[p] for p, n in mine)) / (2 + sum(n for _, n in mine))
            for i, name in enumerate(VOTES):
                voted = [(p, n) for p, n in mine if p[1 + i]]
                hits = sum(n * (posterior[p] if p[1 + i] > 0 else 1 - posterior[p]) for p, n in voted)
                right[k, name] = min(0.99, max(0.51, (8 + hits) / (10 + sum(n for _, n in voted))))
    return posterior, right


def train(found: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Log odds by feature and by kind of a naive Bayes span classifier, learned from all spans with EM's posteriors as labels.

    The driver gets the counts of vote patterns and of features, whose numbers are fixed by the labelers, not by the corpus.
    """
    each = found.select(F.explode(F.concat("base", "wide")).alias("s"))
    counts = {tuple([*r["v"].split(",")[:1], *map(int, r["v"].split(",")[1:])]): r["n"] for r in each.groupBy(F.col("s.votes").alias("v")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}, {}
    posterior, _ = reliabilities(counts)
    label = F.create_map(*[F.lit(x) for p, y in posterior.items() for x in (",".join(map(str, p)), float(y))])
    labelled = each.select("s.kind", "s.features", F.element_at(label, F.col("s.votes")).alias("y"))
    sums = labelled.select("kind", "y", F.explode(F.concat("features", F.array("kind"))).alias("feature")).groupBy("kind", "feature").agg(F.sum("y").alias("yes"), F.sum(1 - F.col("y")).alias("no"))
    rows = sums.collect()
    total = {r["kind"]: (r["yes"], r["no"]) for r in rows if r["feature"] == r["kind"]}

    def odds_of(r) -> float:
        """Each class is smoothed towards the share that the feature has in both, so that a rare feature of a small class says nothing."""
        (yes, no), share = total[r["kind"]], (r["yes"] + r["no"]) / sum(total[r["kind"]])
        return math.log((r["yes"] + SMOOTH * share) / (yes + SMOOTH)) - math.log((r["no"] + SMOOTH * share) / (no + SMOOTH))

    return {r["feature"]: odds_of(r) for r in rows if r["feature"] != r["kind"]}, {k: math.log((yes + 1) / (no + 1)) for k, (yes, no) in total.items()}


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base (spans) and added (spans), each span with its score.

    Base spans match a kind's pattern and its check (parts of at most 255, Luhn, number of digits) and stay
    whatever their score. added has matches of wider patterns (spelled-out addresses, addresses of version 6, national
    numbers, identity and account numbers; kinds id and account are only here) that overlap neither a base span nor each
    other, the better one staying, and that the classifier scores at threshold or more. Null texts are empty; rows
    that share a doc_id are apart; an empty table gives no rows; other columns aren't read.

    Regular expressions run once, and spans are stored in the shared folder. No row is grouped or joined afterwards:
    only counts of votes and features are aggregated, and the learned odds are applied to each row's own spans.
    """
    found = shared.materialise(candidates(docs, id_col, text_col))
    odds, prior = train(found)
    table = lambda m: F.create_map(*[F.lit(x) for pair in m.items() for x in pair]) if m else F.create_map().cast("map<string,double>")

    def scored(spans_: Column) -> Column:
        def score(s: Column) -> Column:
            start = F.coalesce(F.try_element_at(table(prior), s["kind"]), F.lit(0.0))
            total = F.aggregate(s["features"], start, lambda a, f: a + F.coalesce(F.try_element_at(table(odds), f), F.lit(0.0)))
            return F.struct(s["start"].alias("start"), s["k"].alias("k"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["value"].alias("value"), (1 / (1 + F.exp(-total))).alias("score"))

        return F.transform(spans_, score)

    out = found.select("doc_id", *[f"n_{k}" for k in KINDS], scored(F.col("base")).alias("base"), scored(F.col("wide")).alias("_wide"))
    # By pattern again, so that each one's spans are apart; they are sorted.
    parts = [f"_w{i}" for i in range(len(WIDE))]
    held = out.withColumns({part: F.expr(f"filter(_wide, w -> w.kind = '{kind}' and w.score >= {float(threshold)!r}D)") for part, (kind, *_) in zip(parts, WIDE, strict=True)})
    better = "struct(-x.score, x.start, x.k) < struct(-w.score, w.start, w.k)"
    best = " and ".join(f"not exists({_meeting(part, 'w')}, x -> {better})" for part in parts)
    every = F.concat(*parts)
    free = F.when(F.size(every) > 1, F.concat(*[F.expr(f"filter({part}, w -> {best})") for part in parts])).otherwise(every)
    return held.select("doc_id", *[f"n_{k}" for k in KINDS], "base", F.array_sort(free).alias("added"))
