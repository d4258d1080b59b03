"""The text operators over the given tables, beside the SQL that must give the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.llm import bpe, chat, decontamination, exact_dedup, language_id, language_model, merkle, near_dedup, periodic_runs, quality, substring_dedup, token_counts, url_templates
from trapline.llm.shared import read, remainder

#: Rules of the url query.
RULES = [url_templates.Rule(*r) for r in (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))]
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    hits = decontamination.find_hits(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    trees = language_id.train(docs, learn=~F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)))
    rows = language_id.identify(docs, trees)
    return rows.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_language_model(spark: SparkSession, folder: str) -> DataFrame:
    docs, held = read(spark, folder, "documents"), F.coalesce(remainder("doc_id", 10) == 0, F.lit(False))
    return language_model.score(docs, language_model.train(docs, learn=~held), held)


def op4_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, folder, "documents"), size=4)


def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    tokens = bpe.encode(read(spark, folder, "documents"), VOCABULARY, decoded=True)
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    texts = chat.formatted(chat.turns_of(rows))
    back = texts.withColumns({"back": chat.turns_back(F.col("formatted")), "under": F.array_join(chat.loss_texts(F.col("formatted"), F.col("loss")), "")})
    told = F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(read(spark, folder, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    held = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    model = quality.train(docs, read(spark, folder, "labels"), learn=~held)
    return quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = exact_dedup.mark_copies(read(spark, folder, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_url_templates(spark: SparkSession, folder: str) -> DataFrame:
    return url_templates.judge(read(spark, folder, "pages"), RULES)


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    tampered = F.when(remainder("doc_id", 3) == 0, F.translate("text", UPPER, UPPER.lower())).otherwise(F.col("text"))
    found = merkle.leaf(*[tampered if c == "text" else F.col(c) for c in merkle.FIELDS])
    rows = merkle.manifest(docs.withColumn("found", found), keep=("found",))
    back = merkle.folded(F.col("found"), F.col("proof"))
    proof = F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256")
    return rows.select("doc_id", "leaf", "subroot", "root", proof, back.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    loop = F.when(number % 10 == 0, F.floor(number / 10))
    rows = periodic_runs.find_runs(read(spark, folder, "documents"), loop=loop)
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    more = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    best = F.aggregate("runs", none, lambda best, x: F.when(more(best, x), x).otherwise(best))
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n")))
    return rows.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, folder, "documents"), VOCABULARY)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in (op1_decontamination, op2_language_id, op3_language_model, op4_near_dedup, op5_bpe, op6_chat_format, op7_substring_dedup, op8_quality, op9_exact_dedup, op10_url_templates, op11_merkle_manifest, op12_periodic_runs, op13_token_counts)
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_ESCAPED = r"regexp_replace(regexp_replace(coalesce({}, ''), '<(\\*)(/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g')"

SQL: dict[str, str] = {
    "op1_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
item_windows AS (SELECT item_id, list_slice(w, i, i + least(len(w), 10) - 1) AS win FROM
    (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS size FROM item_windows),
doc_windows AS (SELECT doc_id, i, size, list_slice(w, i, i + size - 1) AS win FROM
    (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT x.doc_id, x.i, x.size, y.item_id FROM doc_windows x JOIN item_windows y ON x.win = y.win),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS pos FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN items i ON i.doc_id = d.doc_id""",
    "op4_near_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, i, i + 3), ' ')) AS s FROM
    (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
edges AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT u AS id, u AS other FROM edges UNION SELECT r.id, e.v FROM reach r JOIN edges e ON e.u = r.other),
least AS (SELECT id, min(other) AS component FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(l.component, d.doc_id) AS component_id, coalesce(l.component, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN sizes z ON z.doc_id = d.doc_id LEFT JOIN least l ON l.id = d.doc_id""",
    "op6_chat_format": f"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(3 + sum(17 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id""",
    "op7_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 12), ' ')) AS win FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
firsts AS (SELECT win, min(doc_id) AS first_id FROM windows GROUP BY win),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS pos FROM windows x JOIN firsts f ON f.win = x.win AND f.first_id < x.doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
kept AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.pos) AS kept, count(*) AS n FROM words k ANTI JOIN gone g ON g.doc_id = k.doc_id AND g.pos = k.pos GROUP BY k.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id""",
    "op9_exact_dedup": f"""
WITH t AS (SELECT doc_id, sha256({_LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256 FROM t JOIN g ON g.text_sha256 = t.text_sha256""",
    "op10_url_templates": f"""
WITH RECURSIVE rules AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) r(verdict, h, p)),
parts AS (SELECT page_id, {_LOWER.format("regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
ruled AS (SELECT p.*, regexp_replace(path, '[0-9]+', '#', 'g') AS shape, (SELECT arg_max(h || r.p, length(h || r.p)) FROM rules r WHERE (host = h OR host LIKE '%.' || h) AND starts_with(path, r.p)) AS rule FROM parts p),
labelled AS (SELECT u.*, CASE r.verdict WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END AS blocked FROM ruled u LEFT JOIN rules r ON r.h || r.p = u.rule),
shapes AS (SELECT host, shape, count(*) AS n, count(blocked) AS labelled, coalesce(sum(blocked), 0) AS blocked FROM labelled GROUP BY host, shape),
segments AS (SELECT host, shape, n, unnest(s) AS segment, generate_subscripts(s, 1) AS depth FROM
    (SELECT host, shape, n, list_filter(string_split(shape, '/'), lambda x: x <> '') AS s FROM shapes)),
each AS (SELECT host, depth, segment, sum(n) AS n FROM segments GROUP BY ALL),
levels AS (SELECT host, depth, count(*) AS kinds, sum(n) AS total FROM each GROUP BY ALL),
variable AS (SELECT e.host, e.depth, e.segment FROM each e JOIN levels l ON l.host = e.host AND l.depth = e.depth WHERE kinds > 50 AND n * 50 < total),
steps AS (SELECT s.host, s.shape, list(CASE WHEN v.host IS NULL THEN s.segment ELSE '*' END ORDER BY s.depth) AS steps FROM segments s
    LEFT JOIN variable v ON v.host = s.host AND v.depth = s.depth AND v.segment = s.segment GROUP BY s.host, s.shape),
found AS (SELECT s.*, coalesce(t.steps, []) AS steps FROM shapes s LEFT JOIN steps t ON t.host = s.host AND t.shape = s.shape),
paths AS (SELECT host, shape, labelled, blocked, depth, '/' || array_to_string(list_slice(steps, 1, depth), '/') AS node FROM
    (SELECT *, unnest(generate_series(0, len(steps))) AS depth FROM found)),
tree AS (SELECT host, depth, node, CAST(sum(labelled) AS DOUBLE) AS l, CAST(sum(blocked) AS DOUBLE) AS b FROM paths GROUP BY ALL),
line AS (SELECT p.host, p.shape, p.depth, p.node, t.l, t.b FROM paths p JOIN tree t ON t.host = p.host AND t.depth = p.depth AND t.node = p.node),
overall AS (SELECT (coalesce(sum(blocked), 0) + 1.0::DOUBLE) / (coalesce(sum(labelled), 0) + 2.0::DOUBLE) AS rate FROM found),
walk AS (SELECT host, shape, depth, node AS template, (b + 4.0::DOUBLE * rate) / (l + 4.0::DOUBLE) AS purity, l, b FROM line, overall WHERE depth = 0
    UNION ALL SELECT host, shape, depth, CASE WHEN apart THEN node ELSE template END,
        CASE WHEN apart THEN (nb + 4.0::DOUBLE * purity) / (nl + 4.0::DOUBLE) ELSE purity END, nl, nb FROM
    (SELECT w.host, w.shape, x.depth, x.node, w.template, w.purity, x.l AS nl, x.b AS nb,
        CASE WHEN x.l >= 5 AND w.l - x.l > 0 THEN abs(x.b / x.l - (w.b - x.b) / (w.l - x.l)) > 3.0::DOUBLE * sqrt(w.b / w.l * (1.0::DOUBLE - w.b / w.l) * (1.0::DOUBLE / x.l + 1.0::DOUBLE / (w.l - x.l))) ELSE FALSE END AS apart
     FROM walk w JOIN line x ON x.host = w.host AND x.shape = w.shape AND x.depth = w.depth + 1)),
ends AS (SELECT host, shape, arg_max(template, depth) AS template, arg_max(purity, depth) AS purity FROM walk GROUP BY host, shape)
SELECT u.page_id, u.host, u.path, u.rule, CASE WHEN u.blocked = 1 THEN 'block' WHEN u.blocked = 0 THEN 'allow' WHEN e.purity >= 0.8 THEN 'block' ELSE 'allow' END AS verdict,
    e.template, e.purity FROM labelled u JOIN ends e ON e.host = u.host AND e.shape = u.shape""",
    "op11_merkle_manifest": f"""
WITH RECURSIVE bytes AS (SELECT doc_id, text, lang, source, n_chars, CAST(doc_id AS VARCHAR) AS id, row_number() OVER () AS row FROM documents),
checked AS (SELECT *, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(id, ''), lambda c: CAST(ascii(c) AS UBIGINT))), lambda a, b:
    list_reduce(list_prepend(xor(a, b), [0::UBIGINT, 1, 2, 3, 4, 5, 6, 7]), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)) AS crc FROM bytes),
told AS (SELECT row, doc_id, lang, text, coalesce(strlen(id) || ':' || id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, CASE WHEN xor(crc, 4294967295::UBIGINT) % 3 = 0 THEN {_LOWER.format("text")} ELSE text END AS tampered FROM checked),
leaves AS (SELECT row, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(tampered) || ':' || tampered, '-')) AS found FROM told),
ordered AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS place FROM leaves),
low AS (SELECT 0 AS level, lang, place, leaf AS node FROM ordered
    UNION ALL SELECT level + 1, lang, place // 8, sha256(string_agg(node, '' ORDER BY place)) FROM (SELECT *, count(*) OVER (PARTITION BY level, lang) AS n FROM low) WHERE n > 1 GROUP BY level, lang, place // 8),
tops AS (SELECT lang, max(level) AS height, arg_max(node, level) AS subroot FROM low GROUP BY lang),
listed AS (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM tops),
high AS (SELECT 0 AS level, place, subroot AS node FROM listed
    UNION ALL SELECT level + 1, place // 8, sha256(string_agg(node, '' ORDER BY place)) FROM (SELECT *, count(*) OVER (PARTITION BY level) AS n FROM high) WHERE n > 1 GROUP BY level, place // 8),
crown AS (SELECT max(level) AS height, arg_max(node, level) AS root FROM high),
sides AS (SELECT a.lang, a.level, a.place, coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS before, coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS after
    FROM low a JOIN tops t ON t.lang IS NOT DISTINCT FROM a.lang AND a.level < t.height JOIN low b ON b.lang IS NOT DISTINCT FROM a.lang AND b.level = a.level AND b.place // 8 = a.place // 8 GROUP BY ALL),
high_sides AS (SELECT a.level, a.place, coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS before, coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS after
    FROM high a JOIN crown ON a.level < height JOIN high b ON b.level = a.level AND b.place // 8 = a.place // 8 GROUP BY ALL),
way AS (SELECT o.row, s.level, s.before, s.after FROM ordered o JOIN sides s ON s.lang IS NOT DISTINCT FROM o.lang AND s.place = o.place // CAST(pow(8, s.level) AS BIGINT)
    UNION ALL SELECT o.row, l.height + s.level, s.before, s.after FROM ordered o JOIN listed l ON l.lang IS NOT DISTINCT FROM o.lang JOIN high_sides s ON s.place = l.place // CAST(pow(8, s.level) AS BIGINT)),
proofs AS (SELECT row, count(*) AS steps, string_agg(before || after, '' ORDER BY level) AS proof FROM way GROUP BY row),
fold AS (SELECT row, 0 AS level, found AS node FROM ordered UNION ALL SELECT f.row, f.level + 1, sha256(w.before || f.node || w.after) FROM fold f JOIN way w ON w.row = f.row AND w.level = f.level),
ends AS (SELECT row, arg_max(node, level) AS folded_root FROM fold GROUP BY row)
SELECT o.doc_id, o.leaf, t.subroot, c.root, sha256(coalesce(p.proof, '')) AS proof_sha256, e.folded_root, e.folded_root = c.root AS verified
FROM ordered o JOIN tops t ON t.lang IS NOT DISTINCT FROM o.lang CROSS JOIN crown c JOIN ends e ON e.row = o.row LEFT JOIN proofs p ON p.row = o.row""",
}
