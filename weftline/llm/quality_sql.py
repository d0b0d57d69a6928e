"""The host quality report in DuckDB's SQL, over the view documents."""

from __future__ import annotations

from weftline.llm.quality import RULES, WINDOW, Limits


def quality_sql(limits: Limits = Limits()) -> str:
    blank = r"[\x20\x09-\x0D]"
    fits = []
    for r in RULES:
        mean, free, rest = f"(sum(host_{r}) / sum(host_docs))", "(count(*) - 1)", "(sum(host_docs) - sum((host_docs * host_docs)::double) / sum(host_docs) - (count(*) - 1))"
        correlation = f"(((sum(host_{r} * host_{r} / host_docs) - {mean} * {mean} * sum(host_docs)) / ({mean} * (1 - {mean})) - {free}) / {rest})"
        strength = f"case when {mean} > 0 and {mean} < 1 and {rest} > 1e-9 then case when {correlation} > 1e-9 then 1 / {correlation} - 1 else {limits.max_strength} end else {limits.max_strength} end"
        fits.append(f"{mean} as mean_{r}, least({limits.max_strength}, greatest({limits.min_strength}, {strength})) as strength_{r}")
    over = " or ".join(f"(host_{r} + mean_{r} * strength_{r}) / (host_docs + strength_{r}) > {limits.max_host_rate}" for r in RULES)
    return rf"""with split as (
  select doc_id, source as host, coalesce(text, '') as text,
         list_filter(string_split_regex(coalesce(text, ''), '{blank}+'), lambda x: x <> '') as words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents),
windows as (select doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') as w from (
  select doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) as i from split where len(words) >= {WINDOW})),
often as (select doc_id, i from windows qualify count(*) over (partition by doc_id, w) > 1),
covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + {WINDOW})) as p from often) group by doc_id),
counted as (
  select s.doc_id, host, len(words) as n_words, length(regexp_replace(text, '{blank}', '', 'g')) as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
         coalesce(c.n, 0) as n_repeat_words, len(lines) as n_lines
  from split s left join covered c using (doc_id)),
judged as (
  select *, n_words < {limits.min_words} as fails_few_words, 100 * n_repeat_words > {limits.max_repeat_pct} * n_words as fails_repeats,
         100 * n_symbols > {limits.max_symbol_pct} * word_chars as fails_symbols, 100 * n_dup_lines > {limits.max_dup_line_pct} * n_lines as fails_dup_lines
  from counted),
hosts as (select host, count(*) as host_docs, {", ".join(f"count(*) filter (fails_{r}) as host_{r}" for r in RULES)} from judged where host is not null group by host),
fitted as (select {", ".join(fits)} from hosts),
verdicts as (select hosts.*, {over} as host_rejected from hosts cross join fitted)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
       n_repeat_words::bigint as n_repeat_words, (fails_few_words or fails_repeats) as base_failed,
       not (fails_few_words or fails_repeats) and not coalesce(host_rejected, false) as kept, j.host, n_lines::bigint as n_lines,
       coalesce(host_docs, 0)::bigint as host_docs, {", ".join(f"coalesce(host_{r}, 0)::bigint as host_{r}" for r in RULES)},
       coalesce(host_rejected, false) as host_rejected
from judged j left join verdicts v on j.host = v.host"""
