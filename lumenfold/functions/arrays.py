"""Folds over arrays and spans of patterns, as SQL expressions."""

from __future__ import annotations

BLOCK = 256


def running(array: str, start: str, step: str, value: str, kind: str) -> str:
    """For each element ``e`` of an SQL array, ``value`` of the state ``{s}`` after ``step``. Results are gathered in blocks,
    so what has been gathered is not copied for each element."""
    inside = f"""aggregate(block, named_struct('s', o.s, 'out', cast(array() as array<{kind}>)), (a, e) ->
      element_at(transform(array({step.format(s='a.s')}), s -> named_struct('s', s, 'out', concat(a.out, array({value.format(s='s')})))), 1))"""
    walk = f"""flatten(aggregate(transform(sequence(0, (size(v) - 1) div {BLOCK}), k -> slice(v, k * {BLOCK} + 1, {BLOCK})),
      named_struct('s', {start}, 'out', cast(array() as array<array<{kind}>>)),
      (o, block) -> element_at(transform(array({inside}), r -> named_struct('s', r.s, 'out', concat(o.out, array(r.out)))), 1), o -> o.out))"""
    # a variable holds the array: an expression in a lambda is computed at each step
    return f"element_at(transform(array({array}), v -> if(size(v) = 0, cast(array() as array<{kind}>), {walk})), 1)"


def literal(pattern: str) -> str:
    """A pattern as a raw SQL string."""
    if "'" in pattern:
        raise ValueError("a pattern with a quote")
    return f"r'{pattern}'"


def spans(text: str, pattern: str) -> str:
    """array<struct<start, end, x>> of the matches of a pattern, in code points, from the pieces between them."""
    p = literal(pattern)
    pairs = f"zip_with(slice(split({text}, {p}, -1), 1, size(regexp_extract_all({text}, {p}, 0))), regexp_extract_all({text}, {p}, 0), (g, x) -> named_struct('g', char_length(g), 'x', x))"
    return f"if({text} rlike {p}, {running(pairs, '0', '{s} + e.g + char_length(e.x)', 'named_struct(' + repr('start') + ', {s} - char_length(e.x), ' + repr('end') + ', {s}, ' + repr('x') + ', e.x)', 'struct<start:int,end:int,x:string>')}, cast(array() as array<struct<start:int,end:int,x:string>>))"
