"""The queries of this subpackage, each over its whole table, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, bpe, decontaminate, lines, paragraphs, pii, quality, runs, secrets, simhash, sketch, suffixes, toxicity
from .common import table


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), ranks_path())


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.report(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.report(table(spark, sf_dir, "documents"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.report(table(spark, sf_dir, "documents"))


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3 finds by the base patterns alone."""
    return secrets.report(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4 finds by the base patterns alone."""
    return pii.report(table(spark, sf_dir, "documents")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and base rules of op9."""
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(*columns)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_suffix_array, op2_byte_bpe, op3_secrets, op4_pii, op5_simhash,
        op6_lines, op7_toxicity, op8_decontaminate, op9_quality, op10_paragraphs,
        op11_filter_audit, op12_minhash, op13_runs,
        secrets_base, pii_base, quality_base,
    )
    return {f.__name__: f for f in found}


WORD = r"[^\x20\x09-\x0D]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# every 50-word window of every text, those that two documents have, and what they cover
SHARED = f"""with w as (select doc_id, regexp_extract_all({LOWER}, '{WORD}') as words from documents),
 win as (select doc_id, i, array_to_string(words[i+1:i+50], ' ') as s from w, unnest(range(0, len(words) - 49)) as g(i) where len(words) >= 50),
 sh as (select s from win group by s having count(distinct doc_id) > 1),
 pos as (select distinct doc_id, i from win join sh on sh.s = win.s),
 nw as (select *, case when i > lag(i) over (partition by doc_id order by i) + 50 then 1 else 0 end as nw from pos),
 gp as (select *, sum(nw) over (partition by doc_id order by i) as g from nw),
 sp as (select doc_id, min(i) as a, max(i) + 50 as b from gp group by doc_id, g)
 select doc_id, cast(count(*) as int) as n_spans, cast(sum(b - a) as int) as n_words, string_agg(concat(a, ':', b), ',' order by a) as spans from sp group by doc_id"""

# the definition of the templates: leaves, places, three steps of what is variable, documents of each template
TEMPLATES = f"""with ln as (select doc_id, string_split(text, chr(10)) as l from documents where text is not null and text <> ''),
 li as (select doc_id, i, l[i] as line from ln, unnest(range(1, len(l) + 1)) as g(i)),
 mk as (select *, list_transform(regexp_extract_all(line, '{WORD}'), lambda t: case when regexp_matches(t, '[0-9]') then '' else t end) as m from li),
 ok as (select *, len(m) as n, m[1:case when len(m) >= 8 then 3 else 2 end] as lead from mk where len(m) > 0 and len(list_filter(m, lambda t: t <> '')) >= case when len(m) >= 5 then 0.7 else 0.5 end*len(m)),
 ds as (select n, lead, m, count(distinct doc_id) as docs from ok group by n, lead, m),
 lf as (select n, lead, sum(docs) as total from ds group by n, lead having sum(docs) >= 3),
 pl as (select d.n, d.lead, k, m[k] as t, sum(docs) as c from ds d join lf on lf.n = d.n and lf.lead = d.lead, unnest(range(1, len(m) + 1)) as g(k) where m[k] <> '' and d.n >= 5 group by d.n, d.lead, k, m[k]),
 sc as (select d.n, d.lead, d.m, total, list(coalesce(p.c, 0) order by g.k) as c from ds d join lf on lf.n = d.n and lf.lead = d.lead, unnest(range(1, len(d.m) + 1)) as g(k) left join pl p on p.n = d.n and p.lead = d.lead and p.k = g.k and p.t = d.m[g.k] where d.n >= 5 group by d.n, d.lead, d.m, total),
 tp as (select distinct n, lead, m, list_transform(range(1, len(m) + 1), lambda k: case when c[k] >= greatest(3, share*total) then m[k] end) as key from sc, (values (0.0), (0.125), (0.5)) v(share)),
 ke as (select * from tp where len(list_filter(key, lambda x: x is not null)) >= 0.7*len(key) union all select n, lead, m, m as key from ds where n < 5),
 kd as (select k.n, k.lead, k.key, min(doc_id) as first_id from ke k join ok o on o.n = k.n and o.lead = k.lead and o.m = k.m group by k.n, k.lead, k.key having count(distinct doc_id) >= 3),
 dr as (select distinct o.doc_id, o.i from ok o join ke k on o.n = k.n and o.lead = k.lead and o.m = k.m join kd on kd.n = k.n and kd.lead = k.lead and kd.key = k.key where o.doc_id <> kd.first_id),
 kp as (select li.doc_id, count(*) as n_lines, count(dr.i) as n_dropped, string_agg(case when dr.i is null then line end, chr(10) order by li.i) as text from li left join dr on dr.doc_id = li.doc_id and dr.i = li.i group by li.doc_id)
 select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_dropped, 0) as n_dropped, case when n_dropped > 0 then coalesce(kp.text, '') else d.text end as text from documents d left join kp on kp.doc_id = d.doc_id"""


def _spans_sql(kinds: list[tuple[str, str, int, str]], by: str) -> str:
    """Spans of the matches of each kind's pattern that pass a test of m (a group of the match), in code points."""
    parts = []
    for k, (kind, pattern, group, test) in enumerate(kinds):
        p = pattern.replace("'", "''")
        parts.append(
            f"""select doc_id, {k} as k, '{kind}' as kind, a, a + length(w) as b from (select doc_id, w[i] as w, m[i] as m,
   cast(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0) as bigint) as a
   from (select doc_id, regexp_extract_all(text, '{p}') as w, regexp_extract_all(text, '{p}', {group}) as m, string_split_regex(text, '{p}') as g from documents where text is not null) t, unnest(range(1, len(w) + 1)) as r(i)) x where {test}"""
        )
    counts = ", ".join(f"count(case when k = {k} then 1 end) as n_{kind}" for k, (kind, *_) in enumerate(kinds))
    return f"""with sp as ({' union all '.join(parts)})
 select d.doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' order by {by}), '')) as base_sha256 from documents d left join sp on sp.doc_id = d.doc_id group by d.doc_id"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: case when i % 2 = 1 then cast(reverse({_DIGITS})[i] as int) when cast(reverse({_DIGITS})[i] as int) > 4 then 2*cast(reverse({_DIGITS})[i] as int) - 9 else 2*cast(reverse({_DIGITS})[i] as int) end)) % 10 = 0"
SECRETS = _spans_sql(
    [
        ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, "length(m) >= 12"),
        ("access", "AKIA[A-Z0-9]+", 0, "length(m) >= 18"),
        ("hex", "[0-9a-f]+", 0, "length(m) >= 16"),
    ],
    "a, k",
)
PRIVATE = _spans_sql(
    [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0, "true"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 0, "len(list_filter(string_split(m, '.'), lambda x: coalesce(try_cast(x as hugeint), 256) > 255)) = 0"),
        ("card", r"[0-9]([\x20-]?[0-9])+", 0, f"length({_DIGITS}) between 13 and 19 and {_LUHN}"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0, f"length({_DIGITS}) between 9 and 15"),
    ],
    "k, a",
)

COUNTS = f"""with w as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORD}') as words from documents),
 win as (select doc_id, i, array_to_string(words[i:i+4], ' ') as s from w, unnest(range(1, len(words) - 3)) as g(i) where len(words) >= 5),
 often as (select doc_id, s from win group by doc_id, s having count(*) > 1),
 cov as (select doc_id, count(distinct i + o) as n from win join often using (doc_id, s), (values (0), (1), (2), (3), (4)) v(o) group by doc_id),
 dup as (select doc_id, count(*) - count(distinct x) as n from (select doc_id, unnest(string_split(text, chr(10))) as x from w) t where regexp_matches(x, '{WORD}') group by doc_id),
 al as (select w.doc_id, len(words) as n_words, cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) as bigint) as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols,
   coalesce(dup.n, 0) as n_dup_lines, coalesce(cov.n, 0) as n_repeat_words from w left join dup on dup.doc_id = w.doc_id left join cov on cov.doc_id = w.doc_id)
 select *, n_words < 10 or 100*n_repeat_words > 20*n_words as base_failed from al"""


# each text's failing filters, counted by part and set; every order of the five; a row for each part, order and step
_ORDERS = "select a.f || b.f || c.f || d.f || e.f as filter_order from l a, l b, l c, l d, l e where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5"
INTERACTIONS = f"""with t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
 w as (select *, regexp_extract_all(text, '{WORD}') as words, min(doc_id) over (partition by text) as first_id from t),
 lb as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
 fl as (select w.doc_id, part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
   case when len(words) < 50 then 'A' else '' end || case when 100*len(list_distinct(words)) < 65*len(words) then 'B' else '' end
   || case when 100*length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5*length(text) then 'C' else '' end || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end
   || case when w.doc_id > first_id then 'E' else '' end as fails from w left join lb on lb.doc_id = w.doc_id),
 ce as (select part, fails, count(*) as n, sum(good) as n_good, sum(toxic) as n_toxic from fl group by part, fails),
 l as (select * from (values ('A'), ('B'), ('C'), ('D'), ('E')) v(f)), o as ({_ORDERS}),
 st as (select *, filter_order[step] as f, filter_order[1:step-1] as before from o, (values (1), (2), (3), (4), (5)) v(step)),
 x as (select part, filter_order, step, st.f, n, n_good, n_toxic, contains(fails, st.f) as hit, regexp_matches(fails, '[' || before || '-]') as gone, fails = st.f as alone from ce, st),
 r as (select part, filter_order, cast(step as int) as step, f,
   cast(coalesce(sum(n) filter (not gone and not hit), 0) as bigint) as kept, cast(coalesce(sum(n) filter (not gone and hit), 0) as bigint) as removed,
   cast(coalesce(sum(n) filter (gone and hit), 0) as bigint) as redundant, cast(coalesce(sum(n) filter (alone), 0) as bigint) as unique_fails,
   cast(coalesce(sum(n_good) filter (not gone and hit), 0) as bigint) as good_lost, cast(coalesce(sum(n_toxic) filter (not gone and hit), 0) as bigint) as toxic_lost
   from x group by part, filter_order, step, f)
 select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, f) as bigint) as shapley from r"""

# all pairs that share a shingle, and what is reachable over those that share enough
SIMILAR = f"""with recursive w as (select doc_id, regexp_extract_all({LOWER}, '{WORD}') as words from documents),
 sh as (select doc_id, list_distinct(case when len(words) = 0 then [] when len(words) < 3 then [array_to_string(words, ' ')] else list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i+2], ' ')) end) as s from w),
 e as (select doc_id, unnest(s) as x from sh),
 p as (select a.doc_id as a, b.doc_id as b, count(*) as n from e a join e b on a.x = b.x and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
 k as (select a, b from p join sh x on x.doc_id = a join sh y on y.doc_id = b where 100*n >= 85*(len(x.s) + len(y.s) - n)),
 r as (select a, b from k union select r.a, k.b from r join k on k.a = r.b),
 c as (select doc_id, cast(len(s) as bigint) as n_shingles, least(doc_id, coalesce((select min(b) from r where r.a = doc_id), doc_id)) as component_id from sh)
 select *, doc_id = component_id as kept from c"""


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_array": SHARED, "op6_lines": TEMPLATES, "secrets_base": SECRETS, "pii_base": PRIVATE, "quality_base": COUNTS, "op11_filter_audit": INTERACTIONS, "op12_minhash": SIMILAR}
