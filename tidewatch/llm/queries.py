"""The registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, extract, lexical, packing, pii, quality_lm, quality_rules, secretscan, simhash, topk, urlfilter, variants, warc
from tidewatch.llm.common import table


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", pii.pseudonymised(F.col("text")).alias("text"))


def op8_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def captures(pages: DataFrame) -> DataFrame:
    """The crawl that ``pages`` stands for: each page is a full response, and later is asked for again with
    its validators and answered by a revisit record over the other scheme."""
    tag = F.substring(F.sha2(F.coalesce("html", F.lit("")), 256), 1, 16)
    at = F.col("page_id") * 60
    first = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", at.alias("seconds"), F.lit("response").alias("kind"), F.lit(200).alias("status"), tag.alias("digest"),
        F.create_map(F.lit("etag"), tag, F.lit("content-type"), F.lit("text/html"), F.lit("date"), at.cast("string")).alias("headers"),
    )
    later = at + 3600 * (1 + F.col("page_id") % 48)
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.regexp_replace("url", "^https?:", "https:").alias("url"), later.alias("seconds"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), F.lit(None).cast("string").alias("digest"),
        F.create_map(F.lit("etag"), tag, F.lit("content-type"), F.lit("text/plain"), F.lit("date"), later.cast("string")).alias("headers"),
    )
    return first.unionByName(again)


def op9_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(captures(table(spark, sf_dir, "pages")))
    headers = [F.element_at("headers", F.lit(h)).alias(h.replace("-", "_")) for h in ("etag", "content-type", "date")]
    return found.select("record_id", "canonical_url", "seconds", "status", "resolved_id", "digest", "valid", *headers)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The contract's slips: a run loses a code point where this divides its checksum.
DAMAGED = 199


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.grouped(variants.counted(table(spark, sf_dir, "documents"), damaged=DAMAGED))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scanned(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (op1_exact_topk, op2_html_extraction, op3_bpe_codec, op4_simhash_near_dedup, op5_best_fit_packing, op6_quality_rules, op7_pii_pseudonyms, op8_url_verdicts, op9_revisit_resolution, op10_quality_classifier, op11_spelling_variants, op12_secret_scan, op13_ranked_search)
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FITS = {h + p: (a, f"((host = '{h}' or host like '%.{h}') and starts_with(path, '{p}'))") for a, h, p in sorted(urlfilter.RULES, key=lambda r: -len(r[1] + r[2]))}
_NAMES = ", ".join(f"('{n}')" for n in urlfilter.LISTED)
_LISTED = f"exists (select 1 from (values {_NAMES}) as names(n) where host = n or ends_with(host, '.' || n))"
_CANONICAL = f"""case when h3 <> '' then h3 || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '(?:/index)?\\.html?$|/+$', '', 'g')
    || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '{warc.TRACKING}'))), '&'), ''), '') end"""

ORACLE_SQL: dict[str, str] = {
    "op8_url_verdicts": f"""
        with p as (select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') as host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path from pages),
        r as (select *, case {' '.join(f"when {on} then '{name}'" for name, (_, on) in _FITS.items())} end as rule, case {' '.join(f"when {on} then '{a}'" for a, on in _FITS.values())} end as action, ({_LISTED}) as listed from p)
        select page_id, host, path, rule, coalesce(action, case when listed then 'block' else 'allow' end) as verdict, listed from r""",
    "op9_revisit_resolution": f"""
        with u as (select page_id, url, substr(sha256(coalesce(html, '')), 1, 16) as tag, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^[^@]*@', ''), ':(?:80|443)$', ''), '^(?:www|m)\\.', '') as h3 from pages),
        c as (select page_id, tag, {_CANONICAL} as canonical_url, page_id * 60 as s from u),
        q as (select page_id * 2 + 1 as record_id, canonical_url, s + 3600 * (1 + page_id % 48) as seconds, tag from c),
        m as (select q.*, c.page_id * 2 as rid, c.tag as old, row_number() over (partition by q.record_id order by c.s desc nulls last, c.page_id desc) as n from q left join c on c.canonical_url = q.canonical_url and c.s < q.seconds)
        select record_id, canonical_url, seconds, case when old = tag then 200 else 304 end as status, case when old = tag then rid end as resolved_id, case when old = tag then old end as digest, old = tag as valid,
            tag as etag, case when old = tag then 'text/html' else 'text/plain' end as content_type, seconds::varchar as date from m where n = 1""",
    "op1_exact_topk": """
        with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings),
        scored as (
            select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
            from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id),
        ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from scored)
        select query_id, n::integer as rank, vec_id, score from ranked where n <= 20""",
}

_TERMS = "regexp_extract_all(translate(text, '{u}', '{l}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')".format(u=_UPPER, l=_LOWER)
ORACLE_SQL["op13_ranked_search"] = f"""
    with t as (select doc_id, unnest({_TERMS}) as term from documents),
    d as (select doc_id, count(*) as n from t group by 1),
    s as (select count(*) as docs, sum(n)::bigint as terms from d),
    f as (select doc_id, term, count(*) as tf from t group by 1, 2),
    q as (select item_id, term, count(*) as times from (select item_id, unnest({_TERMS}) as term from benchmark) group by 1, 2),
    w as (select term, floor(1000 * ln((2 * max(docs) + 2) / (2 * count(*) + 1)))::bigint as w from f, s group by 1),
    r as (select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // s.terms))))::bigint as score
        from q join w using (term) join f using (term) join d using (doc_id), s group by 1, 2),
    o as (select *, row_number() over (partition by item_id order by score desc, doc_id)::integer as rank from r where score > 0)
    select item_id, rank, doc_id, score from o where rank <= 10"""
#: The checksum runs over the bytes by a table that is made from its polynomial; pairs meet in what is left without one code point.
ORACLE_SQL["op11_spelling_variants"] = f"""
    with recursive step as (select list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by b) as t from (select unnest(range(256)) as b)),
    runs as (select doc_id, run, count(*) as times from (select doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[a-zÀ-ÿ]+')) as run from documents) where length(run) >= 6 group by 1, 2),
    bytes as (select *, hex(encode(doc_id || ':' || run)) as h from runs),
    crc as (select run, times, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) as h from bytes, step),
    words as (select word, sum(times)::bigint as n from (select case when h % 199 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, times from crc) where length(word) >= 6 group by 1 having sum(times) >= 5),
    cut as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, n, unnest(range(length(word))) as i from words)),
    near as (select a.word as a, b.word as b from cut a join words b on a.rest = b.word union select b.word, a.word from cut a join words b on a.rest = b.word
        union select a.word, b.word from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word),
    best as (select a as word, count(*) as n_near, arg_min(w.word, (-w.n, w.word)) as form from near join words w on w.word = near.b group by 1),
    f as (select words.word, words.n, coalesce(n_near, 0) as n_near, case when w.n >= 5 * words.n then form end as form, case when w.n >= 5 * words.n then w.n end as form_n from words left join best using (word) left join words w on w.word = best.form),
    up as (select word, word as at from f union all select up.word, f.form from up join f on f.word = up.at where f.form is not null),
    last as (select up.word, up.at as root from up join f on f.word = up.at where f.form is null)
    select f.word, n, n_near, form, form_n, root from f join last using (word)"""
