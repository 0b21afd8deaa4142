"""Overlap resolution: an exact fold over a unit's findings in order of priority.

Findings are taken by priority. One that lies inside a kept finding is dropped, one that crosses kept findings is merged
into the first of them, anything else is kept. Then a kept finding of a special category is cut around the names and
proven identifiers that it had swallowed. Unit by unit, so there is no shuffle; arrays are as long as a unit has findings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import taxonomy
from .detect import FINDING, FINDINGS, MODEL_SOURCE, SEED_SOURCE

_KEPT = FINDING[:-1] + f",carved:{FINDINGS}>"
_SPECIAL = ", ".join(f"'{e}'" for e in taxonomy.SPECIAL)
_NER = ", ".join(f"'{e}'" for e in taxonomy.NER_ENTITIES)
_WEAK = f"'{MODEL_SOURCE}', '{SEED_SOURCE}'"


def _by_priority(found: str) -> str:
    """Special categories, longer, checksum tested, higher score, no name type, type, start."""
    rank = f"named_struct('a', f.entity_type not in ({_SPECIAL}), 'b', f.start - f.end, 'c', f.validated is null, 'd', -f.score, 'e', f.entity_type in ({_NER}), 'f', f.entity_type, 'g', f.start, 'h', f)"
    return f"transform(array_sort(transform({found}, f -> {rank})), s -> s.h)"


def _source(kept: str, dropped: str) -> str:
    return f"if({kept}.source in ({_WEAK}) and {dropped}.source not in ({_WEAK}, ''), {dropped}.source, {kept}.source)"


def _kept(source: str, start: str, end: str, value: str, validated: str, carved: str, of: str) -> str:
    return f"named_struct('start', {start}, 'end', {end}, 'entity_type', {of}.entity_type, 'value', {value}, 'score', {of}.score, 'source', {source}, 'validated', {validated}, 'carved', {carved})"


def resolved(found: str, text: str) -> Column:
    """Findings without overlaps, by start. found and text: names of columns."""
    new = _kept("f.source", "f.start", "f.end", "f.value", "f.validated", f"cast(array() as {FINDINGS})", "f")
    survives = "f.entity_type = 'PERSON' or coalesce(f.validated, false)"
    carved = f"if(k.entity_type in ({_SPECIAL}) and ({survives}), concat(k.carved, array(f)), k.carved)"
    absorbed = _kept(_source("k", "f"), "k.start", "k.end", "k.value", "k.validated", carved, "k")
    start, end = "least(f.start, array_min(transform(o, x -> x.start)))", "greatest(f.end, array_max(transform(o, x -> x.end)))"
    merged = _kept(_source("k", "f"), start, end, f"substring({text}, {start} + 1, {end} - {start})", "cast(null as boolean)", "k.carved", "k")
    step = f"""case when size(o) = 0 then concat(kept, array({new}))
      when exists(o, k -> k.start <= f.start and f.end <= k.end) then transform(kept, k -> if(k.start <= f.start and f.end <= k.end, {absorbed}, k))
      else transform(filter(kept, k -> k.start = o[0].start or not (f.start < k.end and k.start < f.end)), k -> if(k.start = o[0].start, {merged}, k)) end"""
    fold = f"""aggregate({_by_priority(found)}, cast(array() as array<{_KEPT}>),
      (kept, f) -> cast(element_at(transform(array(filter(kept, k -> f.start < k.end and k.start < f.end)), o -> {step}), 1) as array<{_KEPT}>))"""
    plain = "named_struct('start', {0}.start, 'end', {0}.end, 'entity_type', {0}.entity_type, 'value', {0}.value, 'score', {0}.score, 'source', {0}.source, 'validated', {0}.validated)"
    # survivors in order of priority, none over another or out of the parent
    chosen = f"""array_sort(aggregate(k.carved, cast(array() as {FINDINGS}),
      (c, s) -> if(s.start < k.start or s.end > k.end or exists(c, x -> s.start < x.end and x.start < s.end), c, concat(c, array(s)))))"""
    # the gaps between them that hold a letter, trimmed
    bounds = "concat(array(k.start), transform(c, s -> s.end))"
    raw = f"zip_with({bounds}, concat(transform(c, s -> s.start), array(k.end)), (a, b) -> named_struct('a', a, 'v', if(b > a, substring({text}, a + 1, b - a), '')))"
    trimmed = r"regexp_replace(g.v, '(?U)^\\s+|\\s+$', '')"
    lead = r"length(g.v) - length(regexp_replace(g.v, '(?U)^\\s+', ''))"
    gap = f"named_struct('start', g.a + {lead}, 'end', g.a + {lead} + length({trimmed}), 'entity_type', k.entity_type, 'value', {trimmed}, 'score', k.score, 'source', k.source, 'validated', k.validated)"
    gaps = f"filter(transform({raw}, g -> {gap}), g -> g.value rlike '\\\\p{{L}}')"
    split = f"element_at(transform(array({chosen}), c -> if(size(c) = 0, array({plain.format('k')}), element_at(transform(array({gaps}), g -> if(size(g) = 0, array({plain.format('k')}), concat(g, c))), 1))), 1)"
    return F.expr(f"cast(array_sort(flatten(transform({fold}, k -> if(size(k.carved) = 0, array({plain.format('k')}), {split})))) as {FINDINGS})")
