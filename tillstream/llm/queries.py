"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstream.llm import (
    conversation_repair, decontamination, fingerprints, impact_search, jaccard_join, language,
    merkle, packing, quality, suffix_dedup, token_cache, toxicity, url_filter,
)
from tillstream.llm.common import remainder, scratch, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.rank_quality(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
        training=remainder("doc_id", 5) != 0)
    return found.select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(
        table(spark, sf_dir, "documents"), training=remainder("doc_id", 4) != 2)
    return found.select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score",
        "margin", "accepted")


def op3_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new cache per call: every distinct text of the table is a miss once."""
    counted = token_cache.count_tokens(
        table(spark, sf_dir, "documents"), scratch(spark, "token-cache"),
        public_tokenizers.path("byte_bpe_50k.json"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


# Fixed values: the contract's rules.
URL_RULES = [
    url_filter.Rule("net/", "block"), url_filter.Rule("example.net/en/", "allow"),
    url_filter.Rule("example.com/de/", "block"), url_filter.Rule("org/fr/", "allow"),
]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    """Documents in sequences of 4096, each piece by the checksum of its ids."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset",
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select(
        "doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score_toxicity(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
        training=remainder("doc_id", 3) != 1)
    return found.select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"),
        F.col("n_hit").cast("long").alias("n_hit"), F.col("n_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op11_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = impact_search.search_all(
        table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("query") % 20 == 0, k=20)
    return found.select(
        F.col("query").alias("query_id"), "rank", F.col("key").alias("vec_id"), "score")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    proofs = merkle.prove_documents(
        table(spark, sf_dir, "documents"),
        tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    return proofs.select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(merkle.siblings(F.col("path")).cast("binary"), 256).alias("proof_sha256"),
        "folded_root", "verified")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation_repair.damage(table(spark, sf_dir, "conversations"))
    return conversation_repair.summarize(conversation_repair.repair_turns(damaged))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_language": op2_language,
    "op3_token_cache": op3_token_cache,
    "op4_url_filter": op4_url_filter,
    "op5_packing": op5_packing,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_decontamination": op8_decontamination,
    "op9_fingerprints": op9_fingerprints,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_impact_search": op11_impact_search,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_conversation_repair": op13_conversation_repair,
}

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

# crc32 over ASCII text, as a table of bytes and a fold over them.
_CRC_TABLE = """
    select list_transform(range(256), lambda i: list_reduce(
        list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384)
                                                     else c >> 1 end)) as t"""


def _crc(text: str) -> str:
    return (f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform("
            f"string_split({text}, ''), lambda b: ascii(b)::bigint)), "
            "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)")


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::varchar)::varchar || ':' || {value}::varchar, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256({})".format(" || ".join(
        map(_field, ("doc_id", "source", "lang", n_chars, "text"))))


_PARENTS = ("list_transform(range(0, len(ds), 2), "
            "lambda i: sha256(ds[i + 1] || coalesce(ds[i + 2], '')))")
_STEP = """list(case when xor(r >> h, 1) >= len(ds) then '-'
                      when (r >> h) & 1 = 1 then 'L' || ds[xor(r >> h, 1) + 1]
                      else 'R' || ds[xor(r >> h, 1) + 1] end order by h)"""

_MERKLE = f"""
    with recursive crc as ({_CRC_TABLE}),
    leaves as (
        select doc_id, lang, {_leaf('n_chars')} as leaf, {_leaf('(n_chars::hugeint + 1)')} as other,
               coalesce({_crc('doc_id::varchar')} % 7 = 0, false) as tampered,
        from documents, crc),
    ranks as (
        select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as r
        from leaves),
    levels as (
        select lang, 0 as h, list(leaf order by r) as ds from ranks group by lang
        union all
        select lang, h + 1, {_PARENTS} from levels where len(ds) > 1),
    subroots as (
        select lang, ds[1] as subroot, row_number() over (order by lang nulls first) - 1 as r
        from levels where len(ds) = 1),
    tops as (
        select 0 as h, list(subroot order by r) as ds from subroots
        union all
        select h + 1, {_PARENTS} from tops where len(ds) > 1),
    below as (
        select r, l.lang, {_STEP} filter (len(ds) > 1) as steps
        from (select distinct lang, r from ranks) l
        join levels on l.lang is not distinct from levels.lang group by all),
    above as (
        select r, lang, subroot, {_STEP} filter (len(ds) > 1) as steps
        from subroots, tops group by all),
    paths as (
        select ranks.*, subroot, (select ds[1] from tops where len(ds) = 1) as root,
               list_concat(coalesce(below.steps, []), coalesce(above.steps, [])) as steps
        from ranks join below on ranks.r = below.r and ranks.lang is not distinct from below.lang
        join above on ranks.lang is not distinct from above.lang),
    folded as (
        select *, list_reduce(list_prepend(if(tampered, other, leaf), steps), lambda a, s:
            sha256(case when s = '-' then a when s[1] = 'L' then s[2:] || a else a || s[2:] end))
            as folded_root
        from paths)
    select doc_id, leaf, subroot, root,
           sha256(array_to_string(list_transform(list_filter(steps, lambda s: s <> '-'),
                                                 lambda s: s[2:]), '')) as proof_sha256,
           folded_root, folded_root = root as verified
    from folded"""

_IMPACTS = """
    with v as (
        select row_number() over () as n, vec_id,
               list_transform(embedding, lambda x: floor(64 * x::double)) as e
        from embeddings
        where embedding is not null
          and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    scored as (
        select q.n, q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
        from v q join v c on q.n <> c.n where q.vec_id % 20 = 0)
    select query_id, rank::integer as rank, vec_id, score
    from (select *, row_number() over (
              partition by n order by score desc, vec_id nulls last) as rank from scored)
    where rank <= 20"""


def _cheapest(*options: str) -> str:
    return f"list_sort(list_filter([{', '.join(options)}], lambda x: x is not null))[1]"


def _edit(letter: str, cost: str, line: str, rest: str) -> str:
    return (f"{{'c': ({cost} + {rest}.c)::bigint, 'a': '{letter}' || {rest}.a, "
            f"'o': {line} || {rest}.o}}")


def _turn(state: str, follow: str, role: str, initials: dict[str, str]) -> str:
    """The best of deleting, keeping and changing a turn in a state."""
    stays = "fault not in ('blank', 'duplicate')"
    kept = " ".join(
        f"when {stays} and left(role, 1) = '{i}' then "
        + _edit("K", "cut", "chr(10) || role || ':' || text", after)
        for i, after in initials.items())
    changed = _edit("R", "1 + cut", f"chr(10) || '{role}:' || text", follow)
    return _cheapest(
        _edit("D", "2", "''", state), f"case {kept} end", f"case when {stays} then {changed} end")


_USER, _ASSISTANT = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
_REPAIR = rf"""
    with recursive crc as ({_CRC_TABLE}),
    kinds as (
        select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
               {_crc("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20
               as kind
        from conversations, crc),
    damaged as (
        select conv_id, turn, if(kind = 4, 'user', role) as role,
               case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g')
                    else text end as text,
               unnest(range(if(kind = 3, 2, 1))) as copy
        from kinds where kind <> 0),
    numbered as (
        select *, row_number() over (
                   partition by conv_id order by turn nulls first, role, text, copy) as p,
               row_number() over (
                   partition by conv_id, role, text order by turn nulls first, copy) as nth
        from damaged),
    judged as (
        select *, case when not regexp_matches(text, '[^ 	-]') then 'blank'
                       when nth > 1 then 'duplicate'
                       when regexp_extract(text, '([^ 	-])[ 	-]*$', 1)
                            not in ('.', '!', '?') then 'truncated'
                       else '' end as fault,
               lag(role) over (partition by conv_id order by p) as before
        from numbered),
    counts as (
        select conv_id, max(p) as n,
               coalesce(max(turn)::hugeint - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps,
               count(*) filter (fault = 'blank') as blank,
               count(*) filter (fault = 'duplicate') as duplicate,
               count(*) filter (fault = 'truncated') as truncated,
               count(*) filter (before is not null and left(before, 1) || left(role, 1)
                                not in ('su', 'ua', 'au')) as illegal
        from judged group by conv_id),
    best as (
        select conv_id, n + 1 as p,
               {{'c': 0::bigint, 'a': '', 'o': ''}} as f0,
               {{'c': 10::bigint, 'a': 'II', 'o': {_USER} || {_ASSISTANT}}} as fs,
               {{'c': 5::bigint, 'a': 'I', 'o': {_ASSISTANT}}} as fu,
               {{'c': 0::bigint, 'a': '', 'o': ''}} as fa
        from counts
        union all
        select conv_id, p,
               {_cheapest('g0', _edit('I', '5', _USER, 'hu'))},
               {_cheapest('gs', _edit('I', '5', _USER, 'hu'))}, hu,
               {_cheapest('ga', _edit('I', '5', _USER, 'gu'))}
        from (
            select *, {_cheapest('gu', _edit('I', '5', _ASSISTANT, 'ga'))} as hu
            from (
                select judged.conv_id, judged.p, {_turn('f0', 'fu', 'user', {'s': 'fs', 'u': 'fu'})} as g0,
                       {_turn('fs', 'fu', 'user', {'u': 'fu'})} as gs,
                       {_turn('fu', 'fa', 'assistant', {'a': 'fa'})} as gu,
                       {_turn('fa', 'fu', 'user', {'u': 'fu'})} as ga
                from best join (
                    select *, if(fault = 'truncated', 5, 0) as cut from judged) judged
                  on best.conv_id is not distinct from judged.conv_id and judged.p = best.p - 1)))
    select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank,
           coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
           coalesce(illegal, 0)::bigint as illegal, coalesce(f0.c, 0)::bigint as cost,
           coalesce(f0.a, '') as audit, sha256(coalesce(f0.o[2:], '')) as repaired_sha256
    from (select distinct conv_id from conversations) c
    left join counts on c.conv_id is not distinct from counts.conv_id
    left join best on c.conv_id is not distinct from best.conv_id and best.p = 1"""

ORACLES: dict[str, str] = {
    "op11_impact_search": _IMPACTS,
    "op12_merkle_manifest": _MERKLE,
    "op13_conversation_repair": _REPAIR,
    "op8_decontamination": f"""
        with d as (select doc_id, {_WORDS} as w from documents),
        b as (select item_id, {_WORDS} as w from benchmark),
        items as (
            select distinct item_id, w[i:least(i + 9, len(w))] as win
            from (select item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i
                  from b where len(w) > 0)),
        sizes as (select distinct len(win) as n from items),
        places as (
            select doc_id, n, unnest(range(1, len(w) - n + 2)) as i, w
            from d, sizes where len(w) >= n),
        met as (
            select p.doc_id, p.i, p.n, items.item_id
            from places p join items on items.win = p.w[p.i:p.i + p.n - 1]),
        hit as (
            select doc_id, count(distinct pos) as n_hit
            from (select doc_id, unnest(range(i, i + n)) as pos from met) group by doc_id),
        named as (
            select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as list
            from (select distinct doc_id, item_id::varchar as item from met) group by doc_id)
        select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
               coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(list, '')) as items_sha256,
               coalesce(n_hit, 0) > 0 as contaminated
        from d left join hit using (doc_id) left join named using (doc_id)""",
}
