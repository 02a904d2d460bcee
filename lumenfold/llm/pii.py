"""Personal data by weak supervision: labelers vote on spans, EM weighs them, a span classifier decides (DataFrame only).

Patterns cut candidate spans: the base forms of e-mail addresses, IP addresses, payment cards and phone numbers, and
wider forms that base patterns miss (addresses written with "(at)" or "[at]", national phone numbers, card-length digit
runs without a valid check digit). Five labelers vote yes, no or nothing on each candidate: the base pattern, a check of
its digits or parts, a gazetteer (top-level domains, issuer prefixes, reserved networks, area codes), words in the 40
characters before it, and the characters that touch it. Expectation-maximisation over the counts of vote patterns gives
each labeler's reliability and each pattern's probability; with these as soft labels a naive Bayes classifier on features
of the span is fitted. A wider candidate is added if the classifier gives it at least one half and no base span overlaps
it. Base spans always stay.

Everything that touches rows is DataFrame functions. The driver sees counts of vote patterns and feature values only, a
number bounded by the labelers and features (243 patterns, 5 features of at most 5 values, 4 kinds).

Patterns are written so that each position is tried a bounded number of times: a run of name characters or digits is
entered at its start only, and inner loops never give back. They match what the plain patterns match.

Counts of spans by kind (as ``op8_pii`` returns them) include the added ones; the digest of base spans does not.

Defined results: null and empty texts have no spans; rows with a null or repeated id are rows like others; an empty table
gives an empty result; other columns pass through ``find`` under their own names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

KINDS = ("email", "ip", "card", "phone")
NAME = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{NAME}]))[{NAME}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
EMAIL_WIDE = rf"(?<![{NAME}])[{NAME}]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z]{{2,}}+)++"
PHONE_WIDE = r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"

DOMAINS = "com org net edu gov info biz io co de fr es it nl eu uk us ca au jp cn in br ru ch at be pl se".split()
CUES = {
    "email": "mail email e-mail contact write reach courriel correo".split(),
    "ip": "ip host server address adresse client gateway login".split(),
    "card": "card visa mastercard amex credit payment karte carte tarjeta".split(),
    "phone": "phone tel call fax mobile telefon telefono ring".split(),
}
AGAINST = "version release isbn order invoice token sha hash ref serial".split()
FEATURES = ("length", "digits", "marks", "before", "after")
LABELERS = ("pattern", "check", "gazetteer", "context", "edges")
CONTEXT = 40
#: Spans that are gathered at once.
BLOCK = 256


def _scan(array: str, start: str, step: str, value: str, kind: str) -> str:
    """Running fold over an SQL array: for each element ``e``, ``value`` of the state ``s`` after ``step``; ``b`` is the state
    before. ``kind`` is the type of a value. What has been gathered is copied once a block of ``BLOCK`` elements and not for
    each element, so the work grows with the elements."""
    # variables of lambdas hold what is used more than once: an expression in a lambda is computed at each step
    blocks = f"transform(sequence(0, (size(v) - 1) div {BLOCK}), k -> slice(v, k * {BLOCK} + 1, {BLOCK}))"
    inside = f"""aggregate(block, named_struct('s', o.s, 'out', cast(array() as array<{kind}>)), (a, e) ->
      element_at(transform(array(named_struct('b', a.s, 's', {step.format(s='a.s')})), t -> named_struct('s', t.s, 'out', concat(a.out, array({value.format(s='t.s', b='t.b')})))), 1))"""
    walk = f"""flatten(aggregate({blocks}, named_struct('s', {start}, 'out', cast(array() as array<array<{kind}>>)),
      (o, block) -> element_at(transform(array({inside}), r -> named_struct('s', r.s, 'out', concat(o.out, array(r.out)))), 1), o -> o.out))"""
    return f"element_at(transform(array({array}), v -> if(size(v) = 0, cast(array() as array<{kind}>), {walk})), 1)"


def _spans(matches: str, pieces: str) -> str:
    """Code-point spans of matches, from the pieces between them, with the characters before and after each: what a text
    holds is walked once, however many spans it has."""
    n = f"size({matches})"
    each = f"arrays_zip(slice({pieces}, 1, {n}), slice({matches}, 1, {n}), slice({pieces}, 2, {n}), slice({matches}, 2, {n}))"
    named = f"transform({each}, z -> named_struct('g', z['0'], 'x', z['1'], 'after', left(if(z['2'] = '', coalesce(z['3'], ''), z['2']), 1)))"
    step = f"named_struct('at', {{s}}.at + char_length(e.g) + char_length(e.x), 'tail', right(concat(right(concat({{s}}.tail, e.g), {CONTEXT}), e.x), {CONTEXT}))"
    value = f"named_struct('start', {{s}}.at - char_length(e.x), 'end', {{s}}.at, 'x', e.x, 'before', right(concat({{b}}.tail, e.g), {CONTEXT}), 'after', e.after)"
    kind = "struct<start:int,end:int,x:string,before:string,after:string>"
    return f"if({n} = 0, cast(array() as array<{kind}>), {_scan(named, "named_struct('at', 0, 'tail', '')", step, value, kind)})"


def _literal(pattern: str) -> str:
    return "r'" + pattern + "'"


def _words(words) -> str:
    return "(?i)(?:^|[^a-z])(?:" + "|".join(words) + ")(?:[^a-z]|$)"


DIGITS = "regexp_replace(c.x, '[^0-9]', '')"
#: Sum of the digits, every second one from the right doubled, less 9 where that exceeds 9.
LUHN = f"""(aggregate(sequence(1, char_length({DIGITS})), 0, (s, i) -> s +
    if(i % 2 = 1, cast(substring({DIGITS}, -i, 1) as int), element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), cast(substring({DIGITS}, -i, 1) as int) + 1))) % 10 = 0)"""
IP_FINE = "forall(split(c.x, '[.]'), p -> char_length(ltrim('0', p)) <= 3 and cast(concat('0', right(p, 3)) as int) <= 255)"
PHONE_FINE = f"(char_length({DIGITS}) between 9 and 15)"
TLD = "lower(element_at(split(c.x, '[^A-Za-z]+'), -1))"


def _vote(yes: str, no: str = "false") -> str:
    return f"case when {yes} then 1 when {no} then -1 else 0 end"


def _candidates(kind: str, column: str, base: str) -> str:
    """Candidates of one kind with votes and features, as an SQL array of structs."""
    fine = {"email": f"char_length({TLD}) >= 2", "ip": IP_FINE, "card": LUHN, "phone": f"char_length({DIGITS}) between 9 and 15"}[kind]
    known = {
        "email": _vote(f"{TLD} in ({', '.join(map(repr, DOMAINS))})"),
        "ip": _vote("not c.x rlike r'^(?:0|10|127|255)[.]'", "c.x rlike r'^(?:0|127|255)[.]'"),
        "card": _vote(f"{DIGITS} rlike '^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)'", "true"),
        "phone": _vote(f"right({DIGITS}, 10) rlike '^[2-9][0-9]{{2}}[2-9]'"),
    }[kind]
    before, touch_before, touch_after = "c.before", "right(c.before, 1)", "c.after"
    kind_of = lambda x: f"case when {x} = '' then 'edge' when {x} rlike '[A-Za-z0-9]' then 'word' when {x} rlike r'\\s' then 'space' when {x} rlike '[.,;:!?()]' then 'mark' else 'other' end"
    return f"""transform({column}, c -> named_struct('kind', '{kind}', 'start', c.start, 'end', c.end, 'base', {base},
      'votes', concat_ws(',', {_vote(base)}, {_vote(fine, 'true')}, {known},
        {_vote(f"{before} rlike '{_words(CUES[kind])}'", f"{before} rlike '{_words(AGAINST)}'")},
        {_vote(f"not {touch_before} rlike '[A-Za-z0-9]' and not {touch_after} rlike '[A-Za-z0-9]'", 'true')}),
      'features', array(
        concat('length=', cast(least(4, char_length(c.x) div 6) as string)),
        concat('digits=', cast(least(4, char_length({DIGITS}) div 4) as string)),
        concat('marks=', cast(least(3, char_length(regexp_replace(c.x, '[A-Za-z0-9]', '')) div 2) as string)),
        concat('before=', {kind_of(touch_before)}), concat('after=', {kind_of(touch_after)}))))"""


def candidates(documents: DataFrame, *, text_column="text") -> DataFrame:
    """``documents`` without the text, with ``candidates``: kind, start, end, base, votes, features."""
    keep = [c for c in documents.columns if c != text_column]
    names = {f"_pii_k{i}": c for i, c in enumerate(keep)}  # a column of the input may be named like one of ours
    df = documents.select(*[F.col(c).alias(n) for n, c in names.items()], F.col(text_column).alias("text"))
    parts = {
        "m_email": (EMAIL, "contains(text, '@')"),
        "m_wide": (EMAIL_WIDE, "contains(text, '(at)') or contains(text, '[at]')"),
        "m_ip": (IP, "contains(text, '.')"),
        "m_card": (CARD, "true"),
        "m_phone": (PHONE, "contains(text, '+')"),
        "m_national": (PHONE_WIDE, "true"),
    }
    df = df.select(*names, "text", *[F.expr(f"if({test}, coalesce(regexp_extract_all(text, {_literal(p)}, 0), array()), array())").cast("array<string>").alias(n) for n, (p, test) in parts.items()])
    df = df.select(*names, "text", *[F.expr(_spans(n, f"split(text, {_literal(p)}, -1)")).alias(n) for n, (p, _) in parts.items()])
    pieces = [
        _candidates("email", "m_email", "true"),
        _candidates("email", "m_wide", "false"),
        _candidates("ip", "m_ip", f"({IP_FINE})"),
        _candidates("card", "m_card", LUHN),
        _candidates("phone", "m_phone", PHONE_FINE),
        _candidates("phone", "m_national", "false"),
    ]
    return df.select(*[F.col(n).alias(c) for n, c in names.items()], F.expr(f"concat({', '.join(pieces)})").alias("candidates"))


def em(patterns: dict[tuple[int, ...], float], *, rounds: int = 50) -> dict[tuple[int, ...], float]:
    """Probability of each vote pattern being personal data, by Dawid-Skene EM over pattern counts.

    Starts from the majority vote; each labeler has a distribution over its three votes for either class.
    """
    p = {v: (1 + sum(x > 0 for x in v)) / (2 + sum(x != 0 for x in v)) for v in patterns}
    for _ in range(rounds):
        total = sum(patterns.values())
        prior = (sum(n * p[v] for v, n in patterns.items()) + 1) / (total + 2)
        tables = []
        for k in range(len(LABELERS)):
            yes, no = {-1: 1.0, 0: 1.0, 1: 1.0}, {-1: 1.0, 0: 1.0, 1: 1.0}
            for v, n in patterns.items():
                yes[v[k]] += n * p[v]
                no[v[k]] += n * (1 - p[v])
            tables.append(({x: y / sum(yes.values()) for x, y in yes.items()}, {x: y / sum(no.values()) for x, y in no.items()}))
        new = {}
        for v in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(t[0][x] / t[1][x]) for t, x in zip(tables, v))
            new[v] = 1 / (1 + math.exp(-max(-35.0, min(35.0, odds))))
        moved = max((abs(new[v] - p[v]) for v in p), default=0.0)
        p = new
        if moved < 1e-9:
            break
    return p


def train(found: DataFrame) -> dict[str, float]:
    """Weights of the span classifier: ``kind`` and ``kind|feature=value`` to log odds."""
    each = found.select(F.explode("candidates").alias("c"))
    votes = each.groupBy("c.kind", "c.votes").agg(F.count("*").alias("n")).collect()  # at most 4 * 243 rows
    cells = each.select("c.kind", "c.votes", F.explode("c.features").alias("feature")).groupBy("kind", "votes", "feature").agg(F.count("*").alias("n")).collect()
    weights: dict[str, float] = {}
    for kind in KINDS:
        pattern = {tuple(map(int, r["votes"].split(","))): float(r["n"]) for r in votes if r["kind"] == kind}
        p = em(pattern)
        yes, no = 1 + sum(n * p[v] for v, n in pattern.items()), 1 + sum(n * (1 - p[v]) for v, n in pattern.items())
        weights[kind] = math.log(yes / no)
        counts: dict[str, list[float]] = {}
        for r in cells:
            if r["kind"] == kind:
                share = p[tuple(map(int, r["votes"].split(",")))]
                c = counts.setdefault(r["feature"], [0.5, 0.5])
                c[0] += r["n"] * share
                c[1] += r["n"] * (1 - share)
        for feature, (a, b) in counts.items():
            weights[f"{kind}|{feature}"] = math.log(a / yes) - math.log(b / no)
    return weights


def find(documents: DataFrame, *, text_column="text") -> DataFrame:
    """The columns of ``documents`` other than the text, and ``spans``: kind, start, end (code points), base."""
    found = materialize(candidates(documents, text_column=text_column), "pii-candidates")
    weights = train(found)
    table = ", ".join(f"'{k}', {v!r}D" for k, v in weights.items())
    logit = "aggregate(c.features, element_at(w, c.kind), (s, f) -> s + coalesce(element_at(w, concat(c.kind, '|', f)), 0D))".replace("element_at(w,", f"element_at(map({table}),")
    # a base span overlaps a wider one if it starts before its end and ends after its start: one walk from either side
    wide = f"filter(candidates, c -> c.base or {logit} >= 0)"
    sorted_ = f"array_sort(transform({wide}, c -> named_struct('start', c.start, 'end', c.end, 'base', c.base, 'kind', c.kind, 'hit', false)))"
    kind = "struct<start:int,end:int,base:boolean,kind:string,hit:boolean>"
    hit = "named_struct('start', e.start, 'end', e.end, 'base', e.base, 'kind', e.kind, 'hit', e.hit or {})"
    found = found.withColumn("_pii_sorted", F.expr(sorted_))
    found = found.withColumn("_pii_sorted", F.expr(f"if(forall(_pii_sorted, c -> c.base), _pii_sorted, {_scan('_pii_sorted', '-1', 'if(e.base, greatest({s}, e.end), {s})', hit.format('{s} > e.start'), kind)})"))
    back = _scan("reverse(_pii_sorted)", "2147483647", "if(e.base, least({s}, e.start), {s})", hit.format("{s} < e.end"), kind)
    found = found.withColumn("_pii_sorted", F.expr(f"if(forall(_pii_sorted, c -> c.base), _pii_sorted, {back})"))
    chosen = "filter(_pii_sorted, c -> c.base or not c.hit)"
    order = F.expr(f"transform({chosen}, c -> named_struct('k', array_position(array({', '.join(map(repr, KINDS))}), c.kind), 'start', c.start, 'end', c.end, 'base', c.base, 'kind', c.kind))")
    spans = F.transform(F.array_sort(order), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base")))
    return found.withColumn("spans", spans).drop("candidates", "_pii_sorted")


def digest(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def op8_pii(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = "filter(spans, s -> s.base)"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(F.expr(digest(base)), 256).alias("base_sha256"), F.expr(digest("spans")).alias("spans"))
