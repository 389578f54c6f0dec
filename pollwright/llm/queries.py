"""One registered query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pollwright.llm import (
    byte_cnn,
    fingerprints,
    jaccard_groups,
    line_runs,
    link_trust,
    mixing,
    packing,
    phrase_filters,
    quality_lines,
    sharding,
    simhash_cover,
    token_counts,
    turn_trie,
)
from pollwright.llm.common import ORACLES, QUERIES, query, table  # noqa: F401
from pollwright.session import tune


SHARD_BYTES = 1 << 20
MIX_TARGETS = {"clean": 0.9, "low": 0.05, "toxic": 0.05}
URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)

@query("op1_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_lines.fit_line_model(docs, table(spark, sf_dir, "labels"))
    return quality_lines.quality_rules(docs, model)


@query("op2_document_fingerprints")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(table(tune(spark), sf_dir, "documents"))


@query("op3_token_counts")
def token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.prefix_token_counts(table(spark, sf_dir, "documents"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


@query(
    "op4_sharding",
    f"""
    with sizes as (
        select doc_id, octet_length(encode(coalesce(text, ''))) as n_bytes from documents
    ), numbered as (
        select *, row_number() over (partition by doc_id, n_bytes) - 1 as copy from sizes
    ), hashed as (
        select *, cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null') || ':' || n_bytes || ':' || copy),
                                      1, 15) as bigint) as hash
        from numbered
    ), levels as (
        select h.doc_id, h.n_bytes, h.copy, d.depth, hash >> (60 - d.depth) as prefix
        from hashed h, (select unnest(range(0, 61)) as depth) d where h.n_bytes <= {SHARD_BYTES}
    ), buckets as (
        select depth, prefix, sum(n_bytes) as shard_bytes, count(*) as shard_docs
        from levels group by depth, prefix having sum(n_bytes) <= {SHARD_BYTES}
    ), leaves as (
        select doc_id, n_bytes, copy, min(depth) as depth
        from levels join buckets using (depth, prefix) group by doc_id, n_bytes, copy
    )
    select l.doc_id, l.n_bytes, case when depth = 0 then '' else lpad(to_base(prefix, 2), cast(depth as int), '0') end as shard,
           cast(depth as int) as depth, cast(shard_bytes as bigint) as shard_bytes, shard_docs
    from leaves l join levels using (doc_id, n_bytes, copy, depth) join buckets using (depth, prefix)
    union all
    select doc_id, n_bytes, lpad(to_base(hash, 2), 60, '0'), 60, n_bytes, 1 from hashed where n_bytes > {SHARD_BYTES}""",
)
def sharding_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.extendible_shards(table(tune(spark), sf_dir, "documents"), SHARD_BYTES).drop("copy")


@query("op5_mixing")
def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tune(spark), sf_dir, "documents")
    model = mixing.fit_domains(docs, mixing.quality_domains(table(spark, sf_dir, "labels")))
    rates = mixing.mixing_rates(docs, model, MIX_TARGETS)
    chances = [F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(model.domains)]
    return rates.select("doc_id", "tokens", *chances, "rate")


@query(
    "op6_line_dedup",
    """
    with lines as (
        select row, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
               unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) as pos
        from (select *, row_number() over () as row from documents)
    ), keyed as (
        select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines
    ), frequent as (
        select key from keyed where length(key) >= 1 group by key having count(distinct row) >= 10
    ), marked as (
        select row, doc_id, pos, line, key in (select key from frequent) as dropped from keyed
    )
    select doc_id, count(*) as n_lines, cast(count(*) filter (dropped) as bigint) as n_dropped,
           sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256
    from marked group by row, doc_id""",
)
def line_dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_runs.dedup_lines(table(tune(spark), sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op7_packing")
def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op8_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_cnn.score_quality(docs, byte_cnn.fit_byte_cnn(docs, table(spark, sf_dir, "labels")))


@query("op9_url_filters")
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_trust.judge_urls(table(tune(spark), sf_dir, "pages"), URL_RULES)


@query("op10_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_cover.near_duplicates(table(tune(spark), sf_dir, "documents"))


@query(
    "op11_collocations",
    """
    with pieces as (
        select row_number() over () as piece, lang, p from (
            select coalesce(lang, 'und') as lang,
                   unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[.,;:!?\\x0A-\\x0D]')) as p from documents)
    ), words as (
        select piece, lang, regexp_extract_all(p, '[^\\x20\\x09]+') as w from pieces
    ), totals as (
        select lang, sum(len(w)) as n from words group by lang
    ), grams as (
        select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase
        from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from words, (select unnest([1, 2, 3, 4, 5]) as k))
    ), counts as (
        select lang, k, phrase, count(*) as a from grams group by all having count(*) >= 100
    ), candidates as (
        select *, string_split(phrase, ' ') as w from counts where k > 1
    ), inside as (
        select distinct lang, array_to_string(w[i:i + j - 1], ' ') as phrase, a
        from (select lang, a, w, j, unnest(range(1, k - j + 2)) as i from (select *, unnest(range(2, k)) as j from candidates))
    ), kept as (
        select c.* from candidates c
        where not exists (select 1 from inside i where i.lang = c.lang and i.phrase = c.phrase and 100 * i.a >= 100 * c.a)
    ), scored as (
        select c.lang, c.phrase, c.a, x.a as l, y.a as r, t.n, c.cut,
               (1000::hugeint * c.a * t.n) // (x.a::hugeint * y.a) as score
        from (select *, unnest(range(1, k)) as cut from kept) c
        join counts x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:c.cut], ' ')
        join counts y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.cut + 1:], ' ')
        join totals t on t.lang = c.lang
    ), best as (
        select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1
    ), ranked as (
        select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from best
    )
    select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from ranked where rank <= 2000""",
)
def collocations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_filters.collocations(table(tune(spark), sf_dir, "documents"))


@query(
    "op12_jaccard_join",
    """
    with recursive words as (
        select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\\x20\\x09-\\x0D]+') as w from documents
    ), sets as (
        select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
               else list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) end as s
        from words
    ), classes as (
        select md5(array_to_string(list_sort(s), chr(10))) as c, any_value(s) as s, min(doc_id) as first from sets where len(s) > 0 group by 1
    ), tokens as (
        select c, len(s) as n, unnest(s) as t from classes
    ), links as (
        select a.c as a, b.c as b from tokens a join tokens b on a.t = b.t and a.c <> b.c and 100 * a.n >= 90 * b.n and 100 * b.n >= 90 * a.n
        group by a.c, b.c having 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))
    ), reach as (
        select c as a, c as b from classes union select r.a, l.b from reach r join links l on l.a = r.b
    ), components as (
        select r.a as c, min(k.first) as component_id from reach r join classes k on k.c = r.b group by r.a
    )
    select doc_id, len(s) as n_shingles, case when len(s) = 0 then doc_id else component_id end as component_id
    from sets left join components on len(s) > 0 and c = md5(array_to_string(list_sort(s), chr(10)))""",
)
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups.similar_sets(table(tune(spark), sf_dir, "documents"))


TRIE_FAMILY = 100
TRIE_SHARED = 6


@query(
    "op13_conversation_trie",
    f"""
    with turns as (
        select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
               row_number() over (partition by conv_id order by turn nulls first) - 1 as pos
        from conversations where conv_id is not null
    ), convs as (
        select conv_id, count(*) as own, conv_id - conv_id % {TRIE_FAMILY} as base,
               xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(conv_id as varchar), ''), lambda ch: ascii(ch)::bigint)),
                   lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
                       lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)), 4294967295) % {TRIE_SHARED} as h
        from turns group by conv_id
    ), rebuilt as (
        select c.conv_id, t.pos + 1 as depth, t.role, t.text from convs c join turns t on t.conv_id = c.base and t.pos < c.h
        union all
        select c.conv_id, t.pos - c.h + least(c.h, coalesce(b.own, 0)) + 1, t.role, t.text
        from convs c join turns t on t.conv_id = c.conv_id and t.pos >= c.h left join convs b on b.conv_id = c.base
    ), paths as (
        select conv_id, depth, length(text) as chars,
               string_agg(md5(md5(role) || md5(text)), '' order by depth) over (partition by conv_id order by depth) as path
        from rebuilt
        union all
        select conv_id, 0, 0, '' from convs
    ), nodes as (
        select depth, path, min(conv_id) as conv_id, count(*) as n_convs, max(chars) as chars from paths group by depth, path
    ), children as (
        select depth - 1 as depth, left(path, (depth - 1) * 32) as path, count(*) as n_children from nodes where depth > 0 group by all
    ), ending as (
        select depth, path, string_agg(cast(conv_id as varchar), ',' order by conv_id) as ids
        from (select conv_id, max(depth) as depth, arg_max(path, depth) as path from paths group by conv_id) group by depth, path
    ), figures as (
        select n.*, coalesce(n_children, 0) as n_children, (n_convs - 1) * chars as saved
        from nodes n left join children using (depth, path)
    ), below as (
        select up as depth, left(path, up * 32) as path, count(*) filter (n_children = 0) as n_leaves, sum(saved) as saved_tokens
        from (select *, unnest(range(0, depth + 1)) as up from figures) group by all
    )
    select f.conv_id, f.depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, b.n_leaves,
           cast(b.saved_tokens as bigint) as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
    from figures f join below b using (depth, path) left join ending e using (depth, path)
    left join nodes p on f.depth > 0 and p.depth = f.depth - 1 and p.path = left(f.path, (f.depth - 1) * 32)""",
)
def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = turn_trie.ordered_turns(table(tune(spark), sf_dir, "conversations"))
    shared = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(TRIE_SHARED))
    base = F.col("conv_id") - F.col("conv_id") % TRIE_FAMILY
    return turn_trie.prefix_trie(*turn_trie.rebuilt(turns, shared, base, TRIE_SHARED - 1))
