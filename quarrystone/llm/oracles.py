"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

import math

from . import mixing, quality_rules


def _lists(values) -> str:
    return "[" + ", ".join(f"{v!r}" if isinstance(v, str) else repr(float(v)) for v in values) + "]"


def quality_sql() -> str:
    """Features by unnesting words and windows; each vector of cutoffs on each labelled document."""
    q, ws = quality_rules, r"[\x20\x09-\x0D]"
    strata = ", ".join(f"'{s}'" for s in q.STRATA)
    ctes = [
        f"""d as (select row_number() over () as r, doc_id, lang, coalesce(text, '') as text from documents)""",
        f"""w as (select r, doc_id, lang, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words,
              list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as rows from d)""",
        """win as (select r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as x
              from (select r, words, unnest(range(1, len(words) - 1)) as i from w where len(words) >= 3))""",
        """rep as (select r, i from (select r, i, count(*) over (partition by r, x) as n from win) where n > 1)""",
        """cov as (select r, count(distinct i + k) as n from rep, (select unnest([0, 1, 2]) as k) group by r)""",
        f"""f as (select w.r, doc_id, lang, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
              len(regexp_extract_all(text, '{q.SYMBOLS}'))::bigint as n_symbols, (len(rows) - len(list_distinct(rows)))::bigint as n_dup_lines,
              coalesce(cov.n, 0)::bigint as n_repeat_words, len(rows) as lines from w left join cov on cov.r = w.r)""",
        f"""g as (select *, n_words < {q.LEAST_WORDS} or 100 * n_repeat_words > {q.MOST_REPEATED} * n_words as base_failed,
              case when lang in ({strata}) then lang else 'other' end as stratum,
              n_symbols / greatest(n_words, 1) as symbols_per_word, n_dup_lines / greatest(lines, 1) as dup_line_share,
              n_repeat_words / greatest(n_words, 1) as repeat_share, word_chars / greatest(n_words, 1) as chars_per_word from f)""",
        """lab as (select doc_id, min(quality) = 1 as good from labels where quality in (0, 1) group by doc_id)""",
        """h0 as (select g.*, good from g join lab using (doc_id) where not base_failed)""",
    ]
    log1, odds = math.log1p(-q.RISK), math.log(q.RISK) - math.log1p(-q.RISK)
    rules = list(q.RULES)
    steps = ", ".join(f"({j}, {', '.join(f'{v[r]}::double' for r in rules)})" for j, v in enumerate(q.vectors()))
    over = " or ".join(f"{r} > c_{r}" for r in rules)
    ctes += [
        f"""v as (select * from (values {steps}) v("at", {", ".join(f"c_{r}" for r in rules)}))""",
        f"""c as (select stratum, "at", count(*) filter (good) as n, count(*) filter (good and ({over})) as wrong, count(*) filter (not good and ({over})) as rght from h0, v group by all)""",
        f"""p as (select *, case when wrong > n * {q.RISK} then 1.0 else (select sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * {odds} + n * {log1}))
              from range(0, wrong + 1) t(k)) end <= {q.LEVEL} as ok from c)""",
        """e as (select stratum, min("at") filter (not ok) as stop from p group by stratum)""",
        """b as (select stratum, arg_max("at", rght * 1000 - "at") as "at" from p join e using (stratum) where (stop is null or "at" < stop) and rght > 0 group by stratum)""",
        f"""t as (select stratum, {", ".join(f"c_{r}" for r in rules)} from b join v using ("at"))""",
    ]
    return f"""with {", ".join(ctes)}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not coalesce({over}, false) as kept
from g left join t on t.stratum = g.stratum"""


def mixing_sql(targets: mixing.Targets | None = None) -> str:
    """The raking as a chain of window sums over the cells."""
    t = targets or mixing.Targets()
    cols = ("source", "lang", "topic")
    marks = ", ".join(f"len(regexp_extract_all(coalesce(text, ''), '{p}')) as c{i}" for i, (_, p) in enumerate(mixing.TOPICS))
    most = "greatest(" + ", ".join(f"c{i}" for i in range(len(mixing.TOPICS))) + ")"
    topic = " ".join(f"when c{i} = {most} then '{n}'" for i, (n, _) in enumerate(mixing.TOPICS))
    ctes = [
        rf"""c as (select doc_id, source, lang, {marks}, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as n_tokens from documents)""",
        f"""d as (select doc_id, source, lang, n_tokens, case when {most} = 0 or {most} * {mixing.WORDS_A_MARK} < n_tokens then '{mixing.PROSE}' {topic} end as topic from c)""",
    ]
    named = [f"case when {c} in ({', '.join(repr(n) for n in names[:-1])}) then {c} else 'other' end" for c, names in zip(cols, t.names(), strict=True)]
    ctes.append(f"x as (select *, {named[0]} as s, {named[1]} as l, {named[2]} as t from d)")
    ctes.append("tot as (select greatest(sum(n_tokens), 1)::double as total from x)")
    ctes.append("q0 as materialized (select s, l, t, sum(n_tokens) / any_value(total) as m, 1::double as f from x, tot group by s, l, t having sum(n_tokens) > 0)")
    for k, names, weights in zip("slt", t.names(), t.weights(), strict=True):
        rows = ", ".join(f"('{n}', {w}::double)" for n, w in zip(names, weights, strict=True))
        ctes.append(f"o{k} as (select {k} as name, sum(m) as o from q0 group by {k})")
        ctes.append(f"g{k} as materialized (select name, w * pow(o, {t.temper}) / sum(w * pow(o, {t.temper})) over () as w from (values {rows}) v(name, w) join o{k} using (name))")
    n = 0
    for _ in range(mixing.ROUNDS):
        for k in "slt":
            ctes.append(f"q{n + 1} as materialized (select s, l, t, m, coalesce(least({mixing.MOST}, f * (w * {t.budget} / nullif(sum(m * least(1, f)) over (partition by {k}), 0))), 0) as f from q{n} join g{k} on name = {k})")
            n += 1
    # the budget: halving, as a recursive query over the two ends
    ctes.append(f"r as materialized (select s, l, t, m, f as y from q{n})")
    ctes.append(
        f"""h(i, lo, hi) as (select 0, -30::double, 30::double union all
              select i + 1, if(kept < {t.budget}, (lo + hi) / 2, lo), if(kept < {t.budget}, hi, (lo + hi) / 2)
              from (select i, lo, hi, (select sum(m * least(1, exp((lo + hi) / 2) * y)) from r) as kept from h where i < {mixing.HALVINGS}))"""
    )
    ctes.append("k as (select exp((lo + hi) / 2) as k from h order by i desc limit 1)")
    unit = f"('0x' || substr(sha256('{t.seed}:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint / {1 << 52}::double"
    chance = "coalesce(least(1, k.k * r.y), 0)"
    return f"""with recursive {", ".join(ctes)}
select doc_id, source, lang, topic, n_tokens, round({chance}, 6) as keep_prob, {unit} < {chance} as sampled
from x cross join k left join r on r.s = x.s and r.l = x.l and r.t = x.t"""


def rules_sql(rules: tuple[tuple[str, str, str], ...]) -> str:
    """Every rule tried on every address; the longest one that fits decides."""
    listed = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in rules)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    part = lambda i: f"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', {i}), '')"
    return f"""with p as (select row_number() over () as n, page_id, translate({part(1)}, '{upper}', '{lower}') as host, {part(2)} as path from pages),
fits as (select n, r.host || r.path as rule, verdict from p join (values {listed}) r(host, path, verdict) on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)),
best as (select n, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict from fits group by n)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join best using (n)"""
