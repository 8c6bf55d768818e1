"""One query per operator over the whole of its table, reduced to the digest columns that can be compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from curate.llm import binary, chat, decontam, hostrules, html, jaccard, lexical, licenses, negatives, packing, quality, substring, toxicity
from curate.llm.registry import ORACLES, QUERIES, query, table
from curate.operators.skew import join_unique
from curate.storage import stage_path

__all__ = ["ORACLES", "QUERIES"]

_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FOLDED = r"regexp_extract_all(" + _FOLD + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PLAIN = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


@query(
    "op1_chat_format",
    r"""
    with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
               union all select * from (values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v),
    e as (select *, replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t') as body,
                 replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), chr(10), '\l') as name from c)
    select conv_id, count(*) as n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
           cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
           sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
           cast(sum(4 + length(name) + 2 + length(body) + 8) as bigint) as formatted_chars
    from e group by conv_id
    """,
)
def _(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    text = r"\### Assistant: </turn> ok"
    control = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], turns.schema)
    rows = chat.format_chats(chat.as_events(turns.union(control)))
    rows = rows.withColumns({"turns": chat.read_turns(F.col("formatted")), "learnt": F.array_join(chat.read_loss(F.col("formatted"), F.col("loss")), "")})
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query(
    "op2_decontamination",
    f"""
    with d as (select doc_id, coalesce({_FOLDED.format("text")}, []) as w from documents),
    b as (select item_id, w, least(len(w), 10) as n from (select item_id, {_FOLDED.format("text")} as w from benchmark) x where len(w) > 0),
    bw as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as s
           from (select item_id, w, n, unnest(range(1, len(w) - n + 2)) as i from b) y),
    dw as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as s
           from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from b) k where len(w) >= n) z),
    hit as (select doc_id, i, dw.n, item_id from dw join bw on dw.s = bw.s and dw.n = bw.n),
    covered as (select doc_id, count(distinct p) as n_hit
                from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from hit) h) c group by doc_id),
    named as (select doc_id, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as items
              from (select distinct doc_id, item_id from hit) h group by doc_id)
    select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
           sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from d left join covered using (doc_id) left join named using (doc_id)
    """,
)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    verdict = decontam.contamination(docs, table(spark, sf, "benchmark"))
    verdict = verdict.select(
        "_id",
        "_th",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
    return decontam.of_rows(docs, verdict).withColumnRenamed("_id", "doc_id")


@query(
    "op3_substring_dedup",
    f"""
    with d as (select doc_id, coalesce({_PLAIN.format("text")}, []) as w from documents),
    wins as (select doc_id, i, hash(s) as h, md5(s) as m
             from (select doc_id, i, array_to_string(w[i:i + 34], ' ') as s
                   from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35) x) y),
    bad as (select doc_id, i from (select doc_id, i, count(*) over (partition by m) as n from wins) z where n > 1),
    gone as (select distinct doc_id, unnest(range(i, i + 35)) as i from bad),
    word as (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as s from d),
    kept as (select doc_id, string_agg(s, ' ' order by i) as t from word anti join gone using (doc_id, i) group by doc_id),
    cut as (select doc_id, count(*) as n from gone group by doc_id)
    select doc_id, cast(len(w) as bigint) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
    from d left join cut using (doc_id) left join kept using (doc_id)
    """,
)
def _(spark, sf):
    return substring.digests(table(spark, sf, "documents")).withColumnRenamed("_id", "doc_id")


@query("op4_html_extraction")
def _(spark, sf):
    rows = html.extract(table(spark, sf, "pages"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))


@query("op5_quality_classifier")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    model = quality.train(docs, table(spark, sf, "labels"))
    rows = quality.score(docs, model).withColumnRenamed("_id", "doc_id")
    accepted = (F.col("score") >= quality.THRESHOLD).cast("int")
    return rows.select("doc_id", quality.held_out("doc_id").alias("held_out"), "score", accepted.alias("predicted"))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op6_binary_output")
def _(spark, sf):
    path = stage_path(spark, "ids")
    binary.write_ids(table(spark, sf, "documents"), path, vocabulary(), end_id=1)
    return binary.read_documents(spark, path)


@query("op8_best_fit_packing")
def _(spark, sf):
    return packing.pack(packing.pieces(table(spark, sf, "documents"), vocabulary(), end_id=0))


@query("op9_jaccard_join")
def _(spark, sf):
    rows = jaccard.similarity_join(table(spark, sf, "documents"))
    names = rows.groupBy("group").agg(F.min("_id").alias("least")).where("group is not null")
    ids = F.when(F.col("group").isNull(), F.col("_id")).otherwise(F.col("least"))
    linked = join_unique(rows.where("group is not null"), names, "group").unionByName(
        rows.where("group is null").withColumn("least", F.col("_id"))
    )
    return linked.select(F.col("_id").alias("doc_id"), ids.alias("class_id"), "n_links", "n_grams")


@query(
    "op7_host_rules",
    f"""
    with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text, coalesce({_PLAIN.format("text")}, []) as w from documents),
    ln as (select r, s from (select r, unnest(string_split(text, chr(10))) as s from d) x where regexp_matches(s, '[^\\x20\\x09-\\x0D]')),
    lines as (select r, count(*) as n_lines, count(*) - count(distinct s) as n_dup from ln group by r),
    win as (select r, i, count(*) over (partition by r, s) as n
            from (select r, i, array_to_string(w[i:i + 4], ' ') as s from (select r, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5) x) y),
    rep as (select r, count(distinct p) as n_rep from (select r, unnest(range(i, i + 5)) as p from win where n > 1) x group by r),
    c as (select r, doc_id, source, cast(len(w) as bigint) as n_words,
                 cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
                 cast(length(text) - length(translate(text, '#*$%&|<>', '')) as bigint) as n_symbols,
                 coalesce(n_lines, 0) as n_lines, coalesce(n_dup, 0) as n_dup_lines, coalesce(n_rep, 0) as n_repeat_words
          from d left join lines using (r) left join rep using (r)),
    j as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from c),
    f as (select *, base_failed or 100 * n_symbols > 15 * word_chars or 100 * n_dup_lines > 50 * n_lines as failed from j),
    h as (select source, count(*) as n, count(*) filter (failed) as k from f group by source),
    m as (select sum(k) / sum(n) as m, var_samp(round(k / n, 9)) as v from h),
    p as (select m, case when coalesce(m, 0) = 0 or coalesce(v, 0) = 0 then 1000.0 else least(greatest(m * (1 - m) / v - 1, 2.0), 1000.0) end as s from m),
    ok as (select source, (k + m * s) / (n + s) as rate from h, p)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 6) as host_rate, not base_failed and rate <= 0.5 as kept
    from f join ok on f.source is not distinct from ok.source
    """,
)
def _(spark, sf):
    rows = hostrules.judge(table(spark, sf, "documents"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select(F.col("_id").alias("doc_id"), *counts, "base_failed", F.round("host_rate", 6).alias("host_rate"), "kept")


@query("op10_license_scan")
def _(spark, sf):
    rows = licenses.scan(table(spark, sf, "documents"))
    return rows.select(
        F.col("_id").alias("doc_id"),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


@query("op12_toxicity")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    model = toxicity.train(docs, table(spark, sf, "labels"))
    rows = toxicity.score(docs, model).withColumnRenamed("_id", "doc_id")
    found = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return rows.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", found.alias("predicted"))


@query(
    "op11_ranked_search",
    f"""
    with d as (select row_number() over () as r, doc_id, coalesce({_FOLDED.format("text")}, []) as w from documents),
    t as (select r, doc_id, s, count(*) as tf from (select r, doc_id, unnest(w) as s from d) x group by all),
    tot as (select count(*) as nd, cast(sum(len(w)) as bigint) as nw from d where len(w) > 0),
    m as (select r, 100 - 75 + ((75 * len(w) * nd) // nw) as m from d, tot where len(w) > 0),
    df as (select s, cast(floor(1000 * ln(cast(2 * nd + 2 as double) / (2 * count(*) + 1))) as bigint) as weight from t, tot group by s, nd),
    i as (select row_number() over () as i, item_id, coalesce({_FOLDED.format("text")}, []) as w from benchmark),
    q as (select i, item_id, s, count(*) as times from (select i, item_id, unnest(w) as s from i) x group by all),
    sc as (select i, item_id, r, doc_id, cast(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
           from q join df using (s) join t using (s) join m using (r) group by all),
    k as (select *, cast(row_number() over (partition by i order by score desc, doc_id, r) as int) as rank from sc where score > 0)
    select item_id, rank, doc_id, score from k where rank <= 10
    """,
)
def _(spark, sf):
    return lexical.rank(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query(
    "op13_hard_negatives",
    """
    with v as (select row_number() over () as r, vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label,
                      list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q
               from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select a.r as a, a.vec_id as anchor_id, v.r, v.vec_id, v.label = a.label as own, cast(list_dot_product(a.q, v.q) as bigint) as score
          from v a join v on a.r <> v.r where a.vec_id % 100 = 0),
    p as (select * from (select *, row_number() over (partition by a order by score desc, vec_id, r) as k from s where own) x where k <= 5),
    n as (select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
                 cast(row_number() over (partition by p.a, p.r order by s.score desc, s.vec_id, s.r) as int) as rank
          from p join s on p.a = s.a and not s.own and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score)
    select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 5
    """,
)
def _(spark, sf):
    vectors = table(spark, sf, "embeddings")
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(vectors.withColumn("label", turned))
