"""The corpus operators as queries over the synthetic tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.sharding import balance_shards

    return balance_shards(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tideline.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, json_path=public_tokenizers.path("byte_bpe_50k.json"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.ngram_join import similar_documents

    return similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.urls import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.quality import judge_quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge_quality(docs, keep=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.neighbours import near_embeddings

    return near_embeddings(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.toxicity import judge_toxicity

    from pyspark.sql import functions as F

    out = judge_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.html_text import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tideline.llm.langid import label_language

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return label_language(docs).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), "n_switches")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.search import rank_documents

    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tideline.llm.fingerprints import fingerprints

    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_packing": op2_packing,
    "op3_ngram_join": op3_ngram_join,
    "op4_urls": op4_urls,
    "op5_quality": op5_quality,
    "op6_embeddings": op6_embeddings,
    "op7_toxicity": op7_toxicity,
    "op8_html": op8_html,
    "op9_mixing": op9_mixing,
    "op10_language": op10_language,
    "op11_phrases": op11_phrases,
    "op12_search": op12_search,
    "op13_fingerprints": op13_fingerprints,
}

#: Sets as lists of sorted shingles; equal ones are one class; links of classes of which 85 in 100 shingles are common;
#: what is reached over links. Words hold no blank, so a blank keeps them apart in a shingle.
_NGRAM_SQL = r"""with recursive docs as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
sets as materialized (select doc_id, case when len(w) >= 4 then list_sort(list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end s from docs),
named as materialized (select doc_id, len(s) n, case when len(s) > 0 then md5(array_to_string(s, chr(10))) end name, s from sets),
classes as materialized (select name, min(doc_id) doc_id, any_value(n) n, any_value(s) s from named where name is not null group by 1),
entries as materialized (select name, n, unnest(s) x from classes),
links as materialized (select a.name a, b.name b from entries a join entries b on a.x = b.x and a.name <> b.name and 100*least(a.n, b.n) >= 85*greatest(a.n, b.n) group by a.name, b.name, a.n, b.n having 100*count(*) >= 85*(a.n + b.n - count(*))),
reach(a, b) as (select name, name from classes union select r.a, l.b from reach r join links l on l.a = r.b),
least as (select r.a name, min(c.doc_id) component_id from reach r join classes c on c.name = r.b group by 1)
select doc_id, cast(n as bigint) n_shingles, coalesce(component_id, doc_id) component_id from named left join least using(name)"""

#: Every pair of rows with usable vectors, in double precision.
_VECTORS_SQL = """with recursive rows as (select vec_id, embedding::double[] e, coalesce(len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0, false) good from embeddings),
units as materialized (select vec_id, e, sqrt(list_dot_product(e, e)) size from rows where good),
links as materialized (select a.vec_id a, b.vec_id b from units a join units b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_dot_product(a.e, b.e)/(a.size*b.size) >= 0.95),
reach(a, b) as (select vec_id, vec_id from units union select r.a, l.b from reach r join links l on l.a = r.b),
least as (select a, min(b) component from reach group by 1), counts as (select a, count(*) n from links group by 1)
select vec_id, coalesce(n, 0) n_links, coalesce(component, vec_id) component_id, coalesce(component, vec_id) = vec_id kept from rows left join least l on l.a = vec_id left join counts c on c.a = vec_id"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: Scores of all documents that hold a term of an item.
_SEARCH_SQL = f"""with docs as (select doc_id, w, len(w)::bigint size from (select doc_id, {_TERMS} w from documents) where len(w) > 0), total as (select count(*)::bigint many, sum(size)::bigint terms from docs),
asked as (select distinct item_id, unnest({_TERMS}) t from benchmark), held as (select doc_id, size, t, count(*)::bigint tf from (select doc_id, size, unnest(w) t from docs) where t in (select t from asked) group by 1, 2, 3),
weights as (select t, floor(1000*ln((2*many+2)/(2*count(*)+1)))::bigint w from held, total group by t, many),
scores as (select item_id, doc_id, sum(w*((1000000000*tf)//(1000*tf+8*(10+(90*size*many)//terms))))::bigint score from asked join held using(t) join weights using(t), total group by 1, 2)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) rank, doc_id, score from scores where score > 0 qualify rank <= 10"""

#: Phrases by their words, counted within pieces.
_PHRASES_SQL = r"""with pieces as (select coalesce(lang, 'und') lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) p from documents),
words as materialized (select lang, regexp_extract_all(p, '[^\x20\x09]+') w from pieces), places as materialized (select lang, w, unnest(range(1, len(w) + 1)) i from words),
ones as materialized (select lang, w[i] x, count(*)::bigint f from places group by 1, 2), totals as (select lang, sum(f)::bigint n from ones group by 1),
pairs as materialized (select lang, w[i] x, w[i+1] y, count(*)::bigint f from places where i < len(w) group by all having count(*) >= 10),
triples as materialized (select lang, w[i] x, w[i+1] y, w[i+2] z, count(*)::bigint f from places where i + 1 < len(w) group by all having count(*) >= 10),
longer as (select lang, x, y, max(f) f from (select lang, x, y, f from triples union all select lang, y, z, f from triples) group by all),
cuts as (select p.lang, p.x || ' ' || p.y phrase, 1 k, p.f a, l.f l, r.f r from pairs p join ones l on l.lang = p.lang and l.x = p.x join ones r on r.lang = p.lang and r.x = p.y left join longer o on o.lang = p.lang and o.x = p.x and o.y = p.y where o.f is null or 100*o.f < 50*p.f
union all select t.lang, t.x || ' ' || t.y || ' ' || t.z, 1, t.f, l.f, r.f from triples t join ones l on l.lang = t.lang and l.x = t.x join pairs r on r.lang = t.lang and r.x = t.y and r.y = t.z
union all select t.lang, t.x || ' ' || t.y || ' ' || t.z, 2, t.f, l.f, r.f from triples t join pairs l on l.lang = t.lang and l.x = t.x and l.y = t.y join ones r on r.lang = t.lang and r.x = t.z),
scored as (select *, ((1000000::hugeint*a*a)//(l::hugeint*r))::bigint score from cuts), best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) rank, phrase, a, l, r, n, score from best join totals using(lang) qualify rank <= 2000"""

ORACLE_SQL: dict[str, str] = {"op11_phrases": _PHRASES_SQL, "op12_search": _SEARCH_SQL, "op3_ngram_join": _NGRAM_SQL, "op6_embeddings": _VECTORS_SQL}
