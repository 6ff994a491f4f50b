"""The queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import collision_ann, host_suffixes, language_id, line_quality, mixing, phrase_automata, pieces, sharding, signature_trees, suffix_dedup

WORDS = "[x for x in string_split_regex(text, '[ \\t\\n\\r\\f\\x0B\\x1C-\\x1F]+') if x <> '']"
THRESHOLD, GRAM, BANDS, ROWS = 0.5, 3, 32, 2
MIN_WORDS = 50
SEED, SHARDS, ALPHA, BLOCK_TOKENS, SHARD_BLOCKS = 17, 64, 0.8, 512, 100


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    field = line_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return line_quality.label_lines(docs, field)


def op2_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffled(_docs(spark, sf_dir), SHARDS, SEED)


def op3_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_docs(spark, sf_dir), None, ALPHA, BLOCK_TOKENS, SHARD_BLOCKS, SEED)


def op4_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_automata.occurrences(_docs(spark, sf_dir), MIN_WORDS)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_trees.classes(_docs(spark, sf_dir), THRESHOLD, GRAM, BANDS, ROWS)


def op6_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_ann.neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_suffixes.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_docs(spark, sf_dir))


def op9_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.duplicates(_docs(spark, sf_dir), MIN_WORDS)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_docs(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_line_quality, op2_feistel_shards, op3_source_mixture, op4_repeated_phrases, op5_ngram_jaccard, op6_nearest_vectors, op7_page_text, op8_language, op9_suffix_repeats, op10_sentencepiece)}


def _network(x: str) -> str:
    """The Feistel network of `sharding` over x, with columns w (width) and lo (w - w // 2); nested selects, a round each."""
    sql = f"select *, {x} >> lo as fl, {x} & ((1::bigint << lo) - 1) as fr from src"
    for i, (a, b) in enumerate(sharding.round_keys(SEED)):
        half, size, mine = ("fr", "(w - lo)", "fl") if i % 2 == 0 else ("fl", "lo", "fr")
        t = f"(({half} * {a} + {b}) % {sharding.PRIME})"
        sql = f"select * replace (xor({mine}, (({t} * {t}) % {sharding.PRIME}) & ((1::bigint << {size}) - 1)) as {mine}) from ({sql})"
    return sql


def _permuted(rows: str, x: str, n: str) -> str:
    """CTEs that give every row of `rows` a column place: its number x permuted within 0..n-1, with cycle walking."""
    return f"""
    start as (select *, greatest(2, length(ltrim(bin(greatest({n} - 1, 1)), '0')))::bigint as w from {rows}),
    walk as (
      select *, w - w // 2 as lo, {x}::bigint as spot, 0 as step from start
      union all
      select * exclude (fl, fr, spot, step), (fl << lo) | fr as spot, step + 1 as step from ({_network("spot").replace("from src", f"from walk where step = 0 or spot >= {n}")})
    ),
    permuted as (select * exclude (spot, step, w, lo), spot as place from walk where step > 0 and spot < {n})"""


SHUFFLE_SQL = f"""
with recursive numbered as (select doc_id, row_number() over (order by doc_id nulls first) - 1 as row_number, count(*) over () as n from documents),
{_permuted("numbered", "row_number", "n")}
select doc_id, row_number, place, place % {SHARDS} as shard, place // {SHARDS} as slot from permuted"""

MIXTURE_SQL = rf"""
with recursive counted as (
  select doc_id, coalesce(source, '') as source, coalesce(len([x for x in string_split_regex(text, '[ \t\n\r\f\x0B]+') if x <> '']), 0)::bigint as n_tokens,
    md5('{SEED}|' || coalesce(doc_id::varchar, '')) as key from documents),
placed as (select *, (coalesce(sum(n_tokens) over (partition by source order by substr(key, 1, 3), key, doc_id, n_tokens rows between unbounded preceding and 1 preceding), 0) // {BLOCK_TOKENS})::bigint as block from counted),
totals as (select source, (sum(n_tokens) // {BLOCK_TOKENS})::bigint as n_blocks, pow(sum(n_tokens)::double, {ALPHA}) as weight from counted group by source having sum(n_tokens) // {BLOCK_TOKENS} > 0),
quotients as (select source, s.seat, weight / (s.seat * 2 + 1) as quotient from totals, (select unnest(range({SHARD_BLOCKS})) as seat) s),
quota as (select source, count(*) as quota from (select * from quotients order by quotient desc, source, seat limit {SHARD_BLOCKS}) group by source),
parts as (select source, n_blocks, quota from totals join quota using (source)),
shards as (select greatest(1, min(n_blocks // quota)) as n_shards from parts),
inner_rows as (select doc_id, source, n_tokens, block, n_blocks, quota, n_shards from placed join parts using (source), shards where block < n_blocks),
blocks as (select distinct source, block, n_blocks from inner_rows),
{_permuted("blocks", "block", "n_blocks")}
select doc_id, source, n_tokens, block, (place // quota)::bigint as shard from inner_rows join permuted using (source, block, n_blocks) where place // quota < n_shards"""

WINDOWS_SQL = rf"""
w as (select doc_id, {WORDS} as ws from documents where doc_id is not null and text is not null),
spot as (select doc_id, ws, unnest(range(1, len(ws) - {MIN_WORDS - 2})) as p from w where len(ws) >= {MIN_WORDS}),
win as (select doc_id, p - 1 as s, md5(array_to_string(ws[p : p + {MIN_WORDS - 1}], ' ')) as h from spot),
rec as (select h, min(doc_id) as home from win group by h having count(distinct doc_id) > 1),
hit as (select doc_id, s, home from win join rec using (h))"""


def _islands(keys: str) -> str:
    return f"""
marked as (select *, coalesce((s > max(s + {MIN_WORDS}) over (partition by {keys} order by s rows between unbounded preceding and 1 preceding))::int, 1) as fresh from flagged),
grouped as (select *, sum(fresh) over (partition by {keys} order by s) as island from marked)"""


PHRASES_SQL = f"""
with {WINDOWS_SQL}, flagged as (select distinct doc_id, s, home from hit), {_islands("doc_id, home")}
select doc_id, min(s)::int as start_word, (max(s) + {MIN_WORDS})::int as end_word, home from grouped group by doc_id, home, island"""

SUFFIX_SQL = f"""
with {WINDOWS_SQL}, flagged as (select distinct doc_id, s, doc_id = home as first_copy from hit), {_islands("doc_id, first_copy")}
select doc_id, min(s)::int as start_word, (max(s) + {MIN_WORDS})::int as end_word, first_copy from grouped group by doc_id, first_copy, island"""

JACCARD_SQL = rf"""
with recursive w as (select doc_id, {WORDS} as ws from documents where doc_id is not null and text is not null),
g as (select doc_id, unnest(case when len(ws) >= {GRAM} then [array_to_string(ws[p : p + {GRAM - 1}], ' ') for p in range(1, len(ws) - {GRAM - 2})] else [array_to_string(ws, ' ')] end) as gram from w where len(ws) > 0),
d as (select distinct doc_id, gram from g),
sets as (select doc_id, count(*) as size, md5(string_agg(gram, '|' order by gram)) as id from d group by doc_id),
low as (select id, min(doc_id) as doc_id, any_value(size) as size from sets group by id),
rep as (select doc_id, gram from d semi join low using (doc_id)),
common as (select a.doc_id as x, b.doc_id as y, count(*) as n from rep a join rep b on a.gram = b.gram and a.doc_id < b.doc_id group by all),
pairs as (select x, y from common join low p on p.doc_id = x join low q on q.doc_id = y where n / (p.size + q.size - n) >= {THRESHOLD}),
links as (select x, y from pairs union all select y, x from pairs),
walk as (select x as node, x as seen from links union select walk.node, links.y from walk join links on links.x = walk.seen),
class as (select node, min(seen) as class_id from walk group by node),
number as (select x, count(*) as n_links from links group by x),
copies as (select id, count(*) - 1 as n_copies from sets group by id)
select sets.doc_id, coalesce(class_id, low.doc_id) as class_id, coalesce(n_links, 0)::bigint as n_links, n_copies::bigint as n_copies
from sets join low using (id) join copies using (id) left join class on class.node = low.doc_id left join number on number.x = low.doc_id where n_links > 0 or n_copies > 0"""

ORACLE = {"op2_feistel_shards": SHUFFLE_SQL, "op3_source_mixture": MIXTURE_SQL, "op4_repeated_phrases": PHRASES_SQL, "op5_ngram_jaccard": JACCARD_SQL, "op9_suffix_repeats": SUFFIX_SQL}
