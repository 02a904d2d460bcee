"""Requests of a whole table, parsed by DataFrame functions: the same marks, clauses and rules as ``requests.parse``.

Each pattern's matches become marks (kind, start, end, text) of an array column; cuts part the marks into clauses; the rules
are conditions over a clause's marks; a fold leaves the clauses that count; and their marks give task, product ids and dates.
Normalisation is a table for the alphabet of requests (printable ASCII, CJK ideographs, their full-width forms and
punctuation); a text with any other character is parsed in Python, and only such texts are sent there.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.windows import MAX_DAYS
from . import requests
from .arrays import literal, spans
from .requests import DEFAULT_DAYS, EARLIER, PATTERNS, PRODUCT, PRODUCT_WORDS, TASKS, WORDS

#: Characters whose normal form the table knows: full-width forms lie at a fixed distance from ASCII.
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
KNOWN = r"^[\x20-\x7E\n\t\x{3000}-\x{3002}\x{4E00}-\x{9FFF}\x{FF01}-\x{FF5E}]*$"
#: A bit for each kind of mark, and for each group of words of a task: a clause knows what it holds by one number.
BITS = {name: 1 << k for k, name in enumerate([*PATTERNS, "product", *[(task, side) for task in TASKS for side in (0, 1)]])}
FIRST_DAY = "date'0001-01-01'"


def _bits(*names) -> int:
    return sum({BITS[n] for n in names})


def _groups_of(word: str) -> list:
    """The groups of the task table that hold a word; a product id stands for the word product."""
    return [(task, side) for task, groups in TASKS.items() for side, group in enumerate(groups) if word in group or (word == "" and PRODUCT_WORDS & set(group))]


def _marks() -> str:
    kinds = [(p, _bits(k)) for k, p in PATTERNS.items()] + [(f"(?i){PRODUCT.pattern}", _bits("product", *_groups_of("")))]
    kinds += [(f"(?i){p.pattern}", _bits(*_groups_of(w))) for w, p in WORDS.items()]
    return "concat(" + ", ".join(f"transform({spans('t', p)}, m -> named_struct('bits', {bits}, 'start', m.start, 'end', m.end, 'x', m.x))" for p, bits in kinds) + ")"


def _is(*names) -> str:
    return f"m.bits & {_bits(*names)} <> 0"


def _of(*names) -> str:
    return f"filter(c.marks, m -> {_is(*names)})"


def _has(*names) -> str:
    """Each of some kinds stands in the clause."""
    return "(" + " and ".join(f"c.mask & {_bits(n)} <> 0" for n in names) + ")"


def _names(task: str) -> str:
    return _has((task, 0), (task, 1))


def _leads(kind: str) -> str:
    return f"({_has(kind)} and exists({_of(kind)}, m -> m.start = c.first))"


def _ordered(earlier: str, later: str) -> str:
    return f"({_has(earlier, later)} and exists({_of(earlier)}, a -> exists({_of(later)}, b -> a.end <= b.start)))"


def _glue(a: str, b: str) -> str:
    """Only blanks between two places."""
    return rf"({a} <= {b} and not substring(t, {a} + 1, {b} - {a}) rlike r'\S')"


def _negated_task() -> str:
    """A negation before the words of a task, or between them."""
    first = "struct(a.start, a.end) <= struct(b.start, b.end)"
    between = f"exists({_of('not')}, n -> n.end <= if({first}, b.start, a.start) and (n.end <= if({first}, a.start, b.start) or if({first}, a.end, b.end) <= n.start))"
    each = [f"({_names(task)} and exists({_of((task, 0))}, a -> exists({_of((task, 1))}, b -> {between})))" for task in TASKS]
    return f"({_has('not')} and ({' or '.join(each)}))"


def _negated_date() -> str:
    """A negation, perhaps an adverb, a verb, perhaps a particle, and a date, with nothing else between."""
    to_date = f"({_glue('v.end', 'd.start')} or exists({_of('of')}, o -> {_glue('o.end', 'd.start')} and {_glue('v.end', 'o.start')}))"
    to_verb = f"exists({_of('not')}, n -> {_glue('n.end', 'v.start')} or exists({_of('adverb')}, w -> {_glue('w.end', 'v.start')} and {_glue('n.end', 'w.start')}))"
    return f"({_has('not', 'verb')} and exists({_of('relative', 'day')}, d -> exists({_of('verb')}, v -> {to_date} and {to_verb})))"


def _verdict() -> str:
    tasks = " or ".join(_names(t) for t in TASKS)
    return f"""case when {_ordered('ban', 'evidence')} or {_has('claim', 'product')} or {_has('verify', 'claimed')} then 'disclaimed' when {_leads('instead')} and ({tasks}) then 'replaces'
      when {_negated_task()} or {_ordered('not', 'product')} or {_negated_date()} then 'negated' else 'counts' end"""


def _windows(as_of: date) -> tuple[str, str, str]:
    """SQL of reason, start and end from ``kept`` marks."""
    day = f"date'{as_of.isoformat()}'"
    before = (as_of - date.min).days
    number = "ltrim('0', regexp_extract(m.x, r'([0-9]+)', 1))"
    relative, days, ranges = (f"filter(kept, m -> {_is(kind)})" for kind in ("relative", "day", "range"))
    lengths = f"""transform({relative}, m -> named_struct('earlier', regexp_extract(m.x, {literal(PATTERNS['relative'])}, 1) in ({', '.join(map(repr, sorted(EARLIER)))}),
      'fault', case when char_length({number}) > {len(str(MAX_DAYS))} then 'window_too_large' when cast(concat('0', {number}) as int) > {MAX_DAYS} then 'window_too_large' when {number} = '' then 'invalid_window_days' end,
      'n', if(char_length({number}) <= 3, cast(concat('0', {number}) as int), 0)))"""
    part = lambda k: f"regexp_extract(m.x, {literal(PATTERNS['day'])}, {k})"
    dates = f"if(size({days}) = 1 + size({ranges}), transform({days}, m -> if({part(1)} = '0000', null, try_cast(concat({part(1)}, '-', {part(2)}, '-', {part(3)}) as date))), array())"
    found = f"named_struct('l', {lengths}, 'd', {dates}, 'n', size({days}), 'r', size({ranges}))"
    latest = lambda n: f"if({n} > {before + 1} or 2 * {n} - 1 > {before}, named_struct('fault', 'date_out_of_range', 'start', {day}, 'n', 0), named_struct('fault', cast(null as string), 'start', date_sub({day}, {n} - 1), 'n', {n}))"
    fault = lambda text: f"named_struct('fault', '{text}', 'start', {day}, 'n', 0)"
    size = "(datediff(element_at(w.d, -1), w.d[0]) + 1)"
    chosen = f"""case when w.r > 1 or (size(w.l) > 0 and w.n > 0) then {fault('conflicting_dates')}
      when exists(w.d, x -> x is null) then {fault('invalid_date')}
      when exists(w.l, x -> x.fault is not null) then named_struct('fault', element_at(filter(w.l, x -> x.fault is not null), 1).fault, 'start', {day}, 'n', 0)
      when size(w.l) = 0 and size(w.d) = 0 and w.n = 0 then {latest(DEFAULT_DAYS)}
      when size(w.l) = 1 then {latest('w.l[0].n')}
      when size(w.l) = 2 and w.l[0].earlier <> w.l[1].earlier and w.l[0].n = w.l[1].n then {latest('w.l[0].n')}
      when size(w.d) > 0 then case when w.d[0] > element_at(w.d, -1) then {fault('invalid_date_order')} when element_at(w.d, -1) > {day} then {fault('date_after_as_of')}
        when {size} > {MAX_DAYS} then {fault('window_too_large')} when datediff(w.d[0], {FIRST_DAY}) < {size} then {fault('date_out_of_range')} else named_struct('fault', cast(null as string), 'start', w.d[0], 'n', {size}) end
      else {fault('conflicting_dates')} end"""
    return f"element_at(transform(array({found}), w -> {chosen}), 1)"


def parse_table(texts: DataFrame, as_of: date, *, text: str = "text", output: str = "request") -> DataFrame:
    """``texts`` with ``output``: struct<task, product_ids, start, end, reason>, null for a null text."""
    names = {c: f"_request_k{k}" for k, c in enumerate(texts.columns)}  # a column of the input may be named like one of ours
    known = F.col(f"`{text}`").rlike(KNOWN)
    rows = texts.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.when(known, F.translate(F.col(f"`{text}`"), WIDE, NARROW)).alias("t"), F.when(~known, F.col(f"`{text}`")).alias("other"))
    kept_names = [*names.values(), "t", "other"]
    rows = rows.selectExpr(*kept_names, f"{_marks()} as marks")
    cuts = f"array_sort(transform(filter(marks, m -> {_is('break', 'instead')}), m -> named_struct('start', m.start, 'end', if({_is('break')}, m.end, m.start))))"
    rows = rows.selectExpr(*kept_names, "marks", f"{cuts} as cuts")
    bounds = "transform(sequence(0, size(cuts)), i -> named_struct('a', if(i = 0, 0, cuts[greatest(i - 1, 0)].end), 'b', if(i = size(cuts), char_length(t), get(cuts, i).start)))"
    clauses = f"""transform(transform(filter({bounds}, x -> x.a <= x.b and substring(t, x.a + 1, x.b - x.a) rlike r'\\S'), x -> named_struct(
      'first', x.b - char_length(ltrim(replace(replace(substring(t, x.a + 1, x.b - x.a), '\\n', ' '), '\\t', ' '))), 'marks', filter(marks, m -> m.start >= x.a and m.end <= x.b))),
      c -> named_struct('first', c.first, 'marks', c.marks, 'mask', aggregate(c.marks, 0, (bits, m) -> bits | m.bits)))"""
    rows = rows.selectExpr(*kept_names, f"{clauses} as clauses")
    facts = f"""transform(clauses, c -> named_struct('verdict', {_verdict()}, 'takes_back', {_leads('that')} and {_ordered('ban', 'evidence')}, 'checks', {_has('verify', 'product')},
      'marks', c.marks, 'tasks', array({', '.join(_names(t) for t in TASKS)})))"""
    rows = rows.selectExpr(*kept_names, f"{facts} as facts")
    verdicts = "transform(facts, (f, i) -> named_struct('verdict', if(f.checks and coalesce(get(facts, i + 1).takes_back, false), 'disclaimed', f.verdict), 'marks', f.marks, 'tasks', f.tasks))"
    rows = rows.selectExpr(*kept_names, f"{verdicts} as facts")
    last = "coalesce(array_max(transform(facts, (f, i) -> if(f.verdict = 'replaces', i, 0))), 0)"
    rows = rows.selectExpr(*kept_names, "facts", f"{last} as last")
    rows = rows.selectExpr(*kept_names, "filter(facts, (f, i) -> i >= last and f.verdict in ('counts', 'replaces')) as facts")
    rows = rows.selectExpr(*kept_names, "facts", "flatten(transform(facts, f -> f.marks)) as kept")
    ids = f"array_distinct(flatten(transform(facts, f -> transform(array_sort(transform(filter(f.marks, m -> {_is('product')}), m -> named_struct('start', m.start, 'x', upper(m.x)))), m -> m.x))))"
    task = "case " + " ".join(f"when exists(facts, f -> f.tasks[{k}]) then '{t}'" for k, t in enumerate(TASKS)) + " end"
    rows = rows.selectExpr(*kept_names, f"{ids} as ids", f"{task} as task", f"{_windows(as_of)} as w")
    day = f"date'{as_of.isoformat()}'"
    default = (f"date_sub({day}, {DEFAULT_DAYS - 1})", day) if (as_of - date.min).days >= 2 * DEFAULT_DAYS else ("cast(null as date)", "cast(null as date)")
    native = f"""if(t is null, null, named_struct('task', if(w.fault is null, task, null), 'product_ids', ids, 'start', if(w.fault is null, w.start, {default[0]}), 'end', if(w.fault is null, date_add(w.start, w.n - 1), {default[1]}),
      'reason', coalesce(w.fault, if(task is null, 'no_task_signal', null))))"""
    rows = rows.select(*kept_names, F.expr(native).alias("native"), requests.parse_column(F.col("other"), as_of).alias("slow"))
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()], F.when(F.col("other").isNull(), F.col("native")).otherwise(F.col("slow")).alias(output))
