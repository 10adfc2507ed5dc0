"""Registered queries of the core operators and the SQL they are checked against."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lekhya.functions import english, numbers, repetition, similarity, text
from lekhya.operators import cleanup, lattice, quality, sampling, spelling, taxonomy, wer
from lekhya.sources import io
from lekhya.streaming import stream

Q3, TASK, FINAL, Q2, DOCS = "q3_low_confidence_samples", "task_records", "final_examples", "q2_examples", "documents"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- SQL pieces ---------------------------------------------------------------------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _compatibility() -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    one, many = [], []
    for a, b in ((0xA0, 0x180), (0x2000, 0x2200), (0x3000, 0x3001), (0xFB00, 0xFB07), (0xFF01, 0xFF5F)):
        for c in range(a, b):
            k = unicodedata.normalize("NFKC", chr(c))
            if k != chr(c) and unicodedata.normalize("NFC", chr(c)) != k:
                (one if len(k) == 1 else many).append((chr(c), k))
    return one, many


_ONE, _MANY = _compatibility()


def nfkc_sql(c: str) -> str:
    out = f"translate({c}, {_q(''.join(a for a, _ in _ONE))}, {_q(''.join(b for _, b in _ONE))})"
    for a, b in _MANY:
        out = f"replace({out}, {_q(a)}, {_q(b)})"
    return f"nfc_normalize({out})"


def repair_sql(c: str) -> str:
    x = f"coalesce({c}, '')"
    raw = f"unhex(array_to_string(list_transform(string_split({x}, ''), lambda k: printf('%02X', unicode(k))), ''))"
    return f"(case when regexp_matches({x}, 'à[¤¥]|ï¿½') and regexp_full_match({x}, '(?s)[\\x{{00}}-\\x{{FF}}]*') then coalesce(try(decode({raw})), {x}) else {x} end)"


def squeeze_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '[\\s\\v\\x{{1C}}-\\x{{1F}}\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"


def spaces_sql(c: str) -> str:
    return squeeze_sql(f"translate({nfkc_sql(repair_sql(c))}, '।॥|', '   ')")


def tokens_sql(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda t: t <> '')"


def comparison_sql(c: str) -> str:
    return tokens_sql(squeeze_sql(f"regexp_replace({spaces_sql(c)}, '[^0-9A-Za-z\\x{{900}}-\\x{{97F}}]', ' ', 'g')"))


def utterance_sql(c: str) -> str:
    clean = squeeze_sql(f"regexp_replace({nfkc_sql(repair_sql(c))}, '[{text.JOINERS.encode().decode('unicode_escape')}]', ' ', 'g')")
    return f"list_filter(list_transform(string_split({clean}, ' '), lambda t: lower(regexp_replace(t, '[^0-9A-Za-z\\x{{900}}-\\x{{97F}}]+', '', 'g'))), lambda t: t <> '')"


def word_sql(c: str) -> str:
    joined = f"regexp_replace({nfkc_sql(repair_sql(c))}, '[{text.JOINERS.encode().decode('unicode_escape')}]', '', 'g')"
    return f"lower(regexp_replace({joined}, '[^0-9A-Za-z\\x{{900}}-\\x{{97F}}]+', '', 'g'))"


def distance_sql(a: str, b: str) -> str:
    """Edit distance of two token lists of at most 120 distinct tokens: one byte per token, then levenshtein."""
    voc = f"list_sort(list_distinct(list_concat({a}, {b})))"
    code = lambda t: f"array_to_string(list_transform({t}, lambda x: chr(list_position({voc}, x)::int + 5)), '')"
    return f"levenshtein({code(a)}, {code(b)})"


def pairs_sql(alphabet: str, n: int) -> str:
    return "|".join(f"{x}{{{n},}}" for x in alphabet)


DEVANAGARI = "".join(map(chr, range(0x900, 0x980)))
QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- sources ------------------------------------------------------------------------------------------------------

BASE = "https://example.org/store"


@query(f"""select recording_id, nullif(regexp_extract(rec_url_gcp, '/hi/([0-9]+)/', 1), '') folder,
 case when ok then '{BASE}/' || regexp_extract(rec_url_gcp, '/hi/([0-9]+)/', 1) || '/' || recording_id || '_audio.wav' end audio_url,
 case when ok then '{BASE}/' || regexp_extract(rec_url_gcp, '/hi/([0-9]+)/', 1) || '/' || recording_id || '_transcription.json' end json_url, ok
 from (select *, coalesce(regexp_extract(rec_url_gcp, '/hi/([0-9]+)/', 1) <> '', false) and recording_id is not null ok from manifest)""")
def scan_recording_urls(spark: SparkSession, d: str) -> DataFrame:
    return io.recording_urls(io.read_manifest(spark, f"{d}/manifest.parquet"), BASE)


@query("select ok, count(*) n from (select coalesce(regexp_extract(rec_url_gcp, '/hi/([0-9]+)/', 1) <> '', false) and recording_id is not null ok from manifest) group by ok")
def scan_url_status(spark: SparkSession, d: str) -> DataFrame:
    return scan_recording_urls(spark, d).groupBy("ok").agg(F.count("*").alias("n"))


@query(f"""select utterance_id, i - 1 as pos, (i - 1)::double as start, len(o.text)::double / 10 as "end", o.text from
 (select utterance_id, unnest(model_outputs) o, generate_subscripts(model_outputs, 1) i from {TASK}) where o.text is not null and len(o.text)::double / 10 > i - 1""")
def scan_json_segments(spark: SparkSession, d: str) -> DataFrame:
    made = F.to_json(F.transform("model_outputs", lambda o, i: F.struct(i.cast("double").alias("start"), (F.coalesce(F.length(o["text"]), F.lit(-10)) / 10).alias("end"), o["text"].alias("text"))))
    rows = table(spark, d, TASK).select("utterance_id", made.alias("seg"))
    return io.segments(rows, "seg", ["utterance_id"]).withColumn("pos", F.col("pos").cast("long"))


@query(f"select word from {Q3} where word is not null and trim(word, ' ') <> '' and word not in ({', '.join(map(_q, io.NULL_WORDS))})")
def scan_word_list(spark: SparkSession, d: str) -> DataFrame:
    return io.word_list(table(spark, d, Q3))


@query(f"select example_id, coalesce(before, '') prediction, coalesce(reference, '') reference from {FINAL}")
def scan_error_samples(spark: SparkSession, d: str) -> DataFrame:
    listed = F.when(F.col("example_id") % 2 == 0, F.to_json(F.array("before", "reference"))).otherwise(F.to_json(F.struct(F.col("before").alias("prediction"), "reference")))
    return io.error_samples(table(spark, d, FINAL).select("example_id", listed.alias("value")))


@query(f"select row_idx, segment_url audio_path, reference as text from (select * from {TASK} order by row_idx limit 300) where segment_url <> '' and reference <> ''")
def scan_eval_records(spark: SparkSession, d: str) -> DataFrame:
    """Records with audio of their own; the bytes of the reference stand in for it."""
    audio = F.struct(F.col("segment_url").alias("path"), F.encode("reference", "UTF-8").alias("bytes")).alias("audio")
    return io.eval_records(table(spark, d, TASK).select("row_idx", audio, F.col("reference").alias("transcription")), "row_idx", most=300).select("row_idx", "audio_path", "text")


# --- text ---------------------------------------------------------------------------------------------------------


@query(f"select row_idx, {repair_sql('reference')} repaired from {TASK}")
def text_repair(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, TASK).select("row_idx", text.repair_mojibake(F.col("reference")).alias("repaired"))


@query(f"select doc_id, {spaces_sql('text')} normalized from {DOCS}")
def text_normalize_spaces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, DOCS).select("doc_id", text.normalize_spaces(F.col("text")).alias("normalized"))


_TRANSCRIPT = squeeze_sql("regexp_replace(regexp_replace(" + nfkc_sql("coalesce({0}, '')") + r", '[\x{200C}\x{200D}\x{FEFF}।॥|]', ' ', 'g'), '[^0-9A-Za-z\x{900}-\x{97F}\s\v\x{1C}-\x{1F}\x{85}\p{Z}]', ' ', 'g')")


@query(f"select doc_id, {_TRANSCRIPT.replace('{0}', 'text')} normalized from {DOCS}")
def text_normalize_transcript(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, DOCS).select("doc_id", text.normalize_transcript(F.col("text")).alias("normalized"))


@query(f"select sample_id, {word_sql('word')} form from {Q3}")
def text_normalize_word(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, Q3).select("sample_id", text.normalize_word(F.col("word")).alias("form"))


@query(f"select row_idx, array_to_string({utterance_sql('reference')}, ' ') tokens from {TASK}")
def text_utterance_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, TASK).select("row_idx", F.array_join(text.utterance_tokens(F.col("reference")), " ").alias("tokens"))


@query(f"select example_id, array_to_string({comparison_sql('before')}, ' ') tokens from {FINAL}")
def text_comparison_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, FINAL).select("example_id", F.array_join(text.comparison_tokens(F.col("before")), " ").alias("tokens"))


@query(f"""with t as (select example_id, {spaces_sql('before')} s from {FINAL}), k as (select example_id, unnest({tokens_sql('s')}) w, generate_subscripts({tokens_sql('s')}, 1) i from t),
 runs as (select example_id, w, i - row_number() over (partition by example_id, w order by i) g from k), r as (select example_id, max(n) m from (select example_id, w, g, count(*) n from runs group by all) group by 1),
 dom as (select example_id, max(n) m, sum(n) s from (select example_id, w, count(*) n from k group by all) group by 1),
 ch as (select example_id, unnest(string_split(s, '')) c, generate_subscripts(string_split(s, ''), 1) i from t), cr as (select example_id, c, i - row_number() over (partition by example_id, c order by i) g from ch),
 lc as (select example_id, max(n) m from (select example_id, c, g, count(*) n from cr where c not in (' ', '') group by all) group by 1)
 select t.example_id, coalesce(dom.s, 0)::bigint n_tokens, coalesce(r.m, 0)::bigint max_run, coalesce(dom.m / dom.s, 0.0)::double dominant, coalesce(lc.m, 0)::bigint char_run,
 len(regexp_replace(t.s, '[^\\p{{L}}\\p{{N}}\\x{{900}}-\\x{{97F}}]', '', 'g'))::bigint content from t left join r using (example_id) left join dom using (example_id) left join lc using (example_id)""")
def token_profile(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, FINAL).select("example_id", text.normalize_spaces(F.col("before")).alias("s")).select("*", text.words(F.col("s")).alias("w"))
    return t.select(
        "example_id",
        F.size("w").cast("long").alias("n_tokens"),
        repetition.max_token_run(F.col("w")).cast("long").alias("max_run"),
        text.dominant_fraction(F.col("w")).alias("dominant"),
        text.longest_character_run(F.col("s")).cast("long").alias("char_run"),
        text.content_characters(F.col("s")).cast("long").alias("content"),
    )


@query(f"select doc_id, case when len(s) <= 120 then s else rtrim(s[1:117]) || '...' end short from (select doc_id, {spaces_sql('text')} s from {DOCS})")
def text_truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, DOCS).select("doc_id", text.truncate(F.col("text"), 120).alias("short"))


@query(f"select doc_id, array_to_string(regexp_extract_all(text, '\\p{{Nd}}[\\p{{Nd}},]*'), ' ') digits from {DOCS}")
def text_digits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, DOCS).select("doc_id", F.array_join(text.digits(F.col("text")), " ").alias("digits"))


# --- repetition, clean-up -----------------------------------------------------------------------------------------


def loops_sql(rows: str, longest: int = 8) -> str:
    """CTEs for rows (id, w: token list), ending in metrics(id, repeated_token_ratio, max_token_run, max_ngram_repeat).

    For every unit length the tokens that equal the one a unit later form islands; a loop starts where an island holds
    two more units. Loops are taken from the left, of the longest unit first, and the next is looked for behind."""
    return f"""tk as (select id, i, w[i] t, len(w) n, w from (select id, w, unnest(range(1, len(w) + 1)) i from {rows})),
 un as (select unnest(range(1, {longest + 1})) u),
 nx as (select id, i, u, min(case when i + u > n or w[i + u] <> t then i end) over (partition by id, u order by i rows between current row and unbounded following) stop from tk, un),
 cd as (select id, i, max(u) u, arg_max((stop - i) // u + 1, u) c from nx where (stop - i) // u + 1 >= 3 group by id, i),
 lp as (with recursive g as (select id, min(i) i, arg_min(u, i) u, arg_min(c, i) c from cd group by id
   union all select x.id, x.i, x.u, x.c from (select cd.id, min(cd.i) i, arg_min(cd.u, cd.i) u, arg_min(cd.c, cd.i) c from cd join g on cd.id = g.id and cd.i >= g.i + g.u * g.c group by cd.id) x) select * from g),
 ls as (select id, sum(u * c) inside, max(c) copies from lp group by id),
 rn as (select id, max(stop - i + 1) run from nx where u = 1 group by id),
 metrics as (select r.id, case when len(r.w) > 0 then coalesce(inside, 0) / len(r.w) else 0.0 end::double repeated_token_ratio, coalesce(run, 0)::int max_token_run,
   case when len(r.w) > 0 then coalesce(copies, 1) else 0 end::int max_ngram_repeat from {rows} r left join ls on ls.id = r.id left join rn on rn.id = r.id)"""


@query(f"with s as (select example_id id, {spaces_sql('before')} x from {FINAL}), rows as (select id, {tokens_sql('x')} w from s), {loops_sql('rows')} select id example_id, repeated_token_ratio, max_token_run, max_ngram_repeat from metrics")
def repetition_blocks(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, FINAL).select("example_id", text.whitespace_tokens(F.col("before")).alias("w"))
    return t.select("example_id", repetition.repetition_metrics(F.col("w")).alias("m")).select("example_id", "m.*")


@query()
def repetition_collapse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, FINAL).select("example_id", repetition.clean_prediction(F.col("before")).alias("cleaned"))


@query()
def cleanup_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, Q2).select("example_id", numbers.normalize_numbers(F.col("raw_prediction")).alias("normalized"))


_NUMBERS = ", ".join(f"({_q(w)}, {n})" for w, n in numbers.NUMBERS.items())


@query(f"select v.n::bigint as number, count(*) n from (select unnest(string_split(replace(raw_prediction, '़', ''), ' ')) w from {Q2}) t join (values {_NUMBERS}) v(w, n) on t.w = v.w group by v.n")
def number_words(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, Q2).select(F.explode(F.split("raw_prediction", " ")).alias("w"))
    return w.select(numbers.number_value(F.col("w")).cast("long").alias("number")).where("number is not null").groupBy("number").agg(F.count("*").alias("n"))


@query(f"""with t as (select example_id, unnest(string_split(raw_prediction, ' ')) w from {Q2} where raw_prediction is not null)
 select example_id, coalesce(sum(n) filter (n < 100), 0)::bigint total from t left join (values {_NUMBERS}) v(w2, n) on w = w2 group by example_id""")
def number_fold(spark: SparkSession, d: str) -> DataFrame:
    """Runs of numbers under a hundred only add up, which plain SQL can say; number_totals folds all numbers."""
    w = table(spark, d, Q2).where("raw_prediction is not null").select("example_id", F.filter(F.transform(F.split("raw_prediction", " "), lambda t: numbers.number_value(F.when(~F.contains(t, F.lit(numbers.NUKTA)), t))), lambda v: v < 100).alias("v"))
    return w.select("example_id", numbers.fold_values(F.col("v")).alias("total"))


@query()
def number_totals(spark: SparkSession, d: str) -> DataFrame:
    """All number words, hundreds and thousands too: the value of each run, and their total."""
    tokens = text.words(text.squeeze(text.nfkc(F.col("raw_prediction"))))
    runs = table(spark, d, Q2).where("raw_prediction is not null").select("example_id", numbers.number_runs(tokens).alias("runs"))
    values = runs.select("example_id", F.transform("runs", numbers.fold_values).alias("numbers"))
    return values.select("example_id", "numbers", F.aggregate("numbers", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


_AFF = r"""^[\(\[\{"''“‘]+"""
_TAG = (
    "array_to_string(list_transform(list_filter(regexp_split_to_array({x}, '\\s+'), lambda t: t <> ''), lambda t: case when regexp_matches(t, '\\[EN\\].*\\[/EN\\]') then t "
    "when core(t) <> '' and (regexp_matches(core(t), '^[A-Za-z]+(?:[-''][A-Za-z]+)*$') or replace(core(t), '़', '') in ({known}) or (replace(core(t), '़', '') not in ({hindi}) and regexp_matches(replace(core(t), '़', ''), '{hints}'))) "
    "then lead(t) || '[EN]' || core(t) || '[/EN]' || trail(t) else t end), ' ')"
)


def _tag_sql(x: str) -> str:
    lead = f"regexp_extract(t, '{_AFF}')"
    rest = f"t[len({lead}) + 1:]"
    trail = f"""regexp_extract({rest}, '[\\)\\]\\}}"''”’।,!?;:]+$')"""
    core = f"({rest})[1:len({rest}) - len({trail})]"
    out = _TAG.replace("{x}", x).replace("{known}", ", ".join(map(_q, english.BORROWED))).replace("{hindi}", ", ".join(map(_q, english.HINDI))).replace("{hints}", "|".join(english.HINTS))
    return out.replace("core(t)", core).replace("lead(t)", lead).replace("trail(t)", trail)


@query(f"select example_id, case when trim(coalesce(raw_prediction, ''), ' ') = '' then raw_prediction else {_tag_sql(nfkc_sql(repair_sql('raw_prediction')))} end tagged from {Q2}")
def cleanup_english(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, Q2).select("example_id", english.tag_english(F.col("raw_prediction")).alias("tagged"))


@query()
def cleanup_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.cleaned(table(spark, d, Q2).select("example_id", "raw_prediction"), "raw_prediction")


def _lexicon_tag_sql() -> str:
    lead = f"regexp_extract(t, '{_AFF}')"
    rest = f"t[len({lead}) + 1:]"
    trail = f"""regexp_extract({rest}, '[\\)\\]\\}}"''”’।,!?;:]+$')"""
    return f"""with tk as (select example_id, unnest(ts) t, generate_subscripts(ts, 1) i from (select example_id, regexp_split_to_array(trim({nfkc_sql(repair_sql('raw_prediction'))}, ' '), '[\\s\\v\\x{{1C}}-\\x{{1F}}\\x{{85}}\\p{{Z}}]+') ts from {Q2} where raw_prediction is not null)),
 ct as (select *, {lead} lead, ({rest})[1:len({rest}) - len({trail})] core, {trail} trail from tk), ks as (select *, replace(core, '़', '') as key from ct),
 lx as (select distinct replace(suggestion, '़', '') as key, true hindi from {Q3} where suggestion is not null)
 select example_id, string_agg(case when regexp_matches(t, '\\[EN\\].*\\[/EN\\]') or key = '' then t
  when regexp_matches(core, '^[A-Za-z]+(?:[-''][A-Za-z]+)*$') or key in ({", ".join(map(_q, english.BORROWED))}) or (hindi is null and regexp_matches(key, '{"|".join(english.HINTS)}')) then lead || '[EN]' || core || '[/EN]' || trail else t end, ' ' order by i) tagged
 from ks left join lx using (key) group by example_id"""


@query(_lexicon_tag_sql())
def cleanup_lexicon_join(spark: SparkSession, d: str) -> DataFrame:
    hindi = table(spark, d, Q3).where("suggestion is not null").select(F.col("suggestion").alias("word")).distinct()
    return cleanup.tag_with_lexicon(table(spark, d, Q2).where("raw_prediction is not null"), "example_id", "raw_prediction", hindi)


@query(f"select change, count(*) n from (select case when a and b then 'Both' when a then 'Number only' when b then 'English only' else 'No change' end change from (select coalesce(raw_prediction <> normalized, false) a, coalesce(contains(tagged, '[EN]'), false) b from {Q2})) group by change")
def cleanup_coverage(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.coverage(table(spark, d, Q2), "raw_prediction", "normalized", "tagged")


@query(f"select term, count(*) n from (select unnest(regexp_extract_all(tagged, '\\[EN\\](.*?)\\[/EN\\]', 1)) term from {Q2}) group by term order by n desc, term limit 12")
def cleanup_top_terms(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.top_terms(table(spark, d, Q2), "tagged")


@query(f"select example_id, before, after, before is distinct from after changed from {FINAL} order by changed desc, example_id limit 10")
def report_changed_first(spark: SparkSession, d: str) -> DataFrame:
    return cleanup.changed_first(table(spark, d, FINAL).select("example_id", "before", "after"), "before", "after", "example_id")


@query(f"""select source, idx, before, after from (select 0 source, example_id idx, raw_prediction before, normalized after from {Q2} where raw_prediction is distinct from normalized
 union all select 1, example_id, before, after from {FINAL} where before is distinct from after) order by source, idx limit 5""")
def report_examples(spark: SparkSession, d: str) -> DataFrame:
    spare = table(spark, d, FINAL).select(F.col("example_id").alias("idx"), "before", "after")
    return cleanup.examples(table(spark, d, Q2), "raw_prediction", "normalized", "example_id", spare)


@query(f"select a.example_id, a.before, b.after, a.before is not distinct from b.after same from {FINAL} a join {FINAL} b using (example_id)")
def join_before_after(spark: SparkSession, d: str) -> DataFrame:
    """Rows of two runs put side by side by their index."""
    f = table(spark, d, FINAL)
    return f.select("example_id", "before").join(f.select("example_id", "after"), "example_id").withColumn("same", F.col("before").eqNullSafe(F.col("after")))


# --- quality ------------------------------------------------------------------------------------------------------

_SECONDS = "(regexp_extract(segment_url, '_([0-9.]+)_([0-9.]+)[.]wav$', 2)::double - regexp_extract(segment_url, '_([0-9.]+)_([0-9.]+)[.]wav$', 1)::double)"
_GATE = f"""with t as (select row_idx, {_SECONDS} sec, {_TRANSCRIPT.replace('{0}', 'reference')} s from {TASK}),
 k as (select *, {tokens_sql('s')} w, len(regexp_replace(s, '[^\\p{{L}}\\p{{N}}\\x{{900}}-\\x{{97F}}]', '', 'g')) ch from t),
 m as (select *, sec <= 1.6 and len(w) <= 4 short, ch / greatest(sec, 1e-6) rate, list_max(list_transform(list_distinct(w), lambda x: len(list_filter(w, lambda y: y = x)))) / len(w) dom from k),
 g as (select row_idx, s normalized_text, case when sec < 0.35 then 'audio_too_short' when sec > 28 then 'audio_too_long' when s = '' then 'empty_text' when ch = 0 then 'no_content_characters'
  when regexp_matches(s, '{pairs_sql(DEVANAGARI + 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 7)}') then 'repeated_character_noise' when len(w) >= 4 and dom > 0.8 then 'repeated_token_noise'
  when rate < 0.35 and not short then 'transcript_too_sparse' when rate > 32 then 'transcript_too_dense' end drop_reason from m)"""


def _gated(spark: SparkSession, d: str) -> DataFrame:
    at = lambda k: F.regexp_extract("segment_url", r"_([0-9.]+)_([0-9.]+)[.]wav$", k).cast("double")
    return quality.gate(table(spark, d, TASK).select("row_idx", "segment_url", "reference"), "reference", seconds=at(2) - at(1))


@query(_GATE + " select row_idx, normalized_text, drop_reason from g")
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, d).select("row_idx", "normalized_text", "drop_reason")


@query(_GATE + " select coalesce(drop_reason, 'kept') drop_reason, count(*) n from g group by 1")
def quality_drop_counts(spark: SparkSession, d: str) -> DataFrame:
    return quality.drop_counts(_gated(spark, d))


@query(_GATE + " select drop_reason, count(*) n from g where drop_reason is not null group by 1 order by n desc, drop_reason limit 5")
def quality_top_reasons(spark: SparkSession, d: str) -> DataFrame:
    return quality.top_reasons(_gated(spark, d))


@query("""with a as (select vec_id, list_transform(embedding, lambda x: abs(x)::double) l from embeddings), b as (select vec_id, l, list_max(l) peak, list_aggregate(l, 'quantile_cont', 0.6) f from a)
 select vec_id, len(list_filter(l, lambda x: x >= greatest(0.008, 2.5 * f, 0.08 * peak))) / len(l) active, len(list_filter(l, lambda x: x >= 0.995)) / len(l) clipped, peak from b""")
def audio_activity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", quality.audio_metrics(F.col("embedding")).alias("m")).select("vec_id", "m.*")


# --- error rates --------------------------------------------------------------------------------------------------

_PAIR = f"with p as (select example_id, {comparison_sql('before')} a, {comparison_sql('reference')} b from {FINAL})"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, FINAL).select("example_id", text.comparison_tokens(F.col("before")).alias("a"), text.comparison_tokens(F.col("reference")).alias("b"))


@query(_PAIR + f" select example_id, {distance_sql('a', 'b')}::bigint distance from p")
def wer_token_distance(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("example_id", wer.token_distance(F.col("a"), F.col("b")).cast("long").alias("distance"))


@query(_PAIR + f" select sum({distance_sql('a', 'b')})::bigint edits, sum(len(b))::bigint reference_tokens, sum({distance_sql('a', 'b')}) / sum(len(b)) wer from p")
def wer_corpus(spark: SparkSession, d: str) -> DataFrame:
    return wer.corpus_wer(_pairs(spark, d), "a", "b")


_COUNTED = _PAIR + """, x as (select example_id, w, count(*) n from (select example_id, unnest(a) w from p) group by all), y as (select example_id, w, count(*) n from (select example_id, unnest(b) w from p) group by all)"""


@query(_COUNTED + " select p.example_id, case when len(b) = 0 then 0.0 else coalesce(s, 0) / len(b) end ratio from p left join (select example_id, sum(least(x.n, y.n)) s from x join y using (example_id, w) group by 1) using (example_id)")
def wer_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("example_id", wer.overlap_ratio(F.col("a"), F.col("b")).alias("ratio"))


@query(_COUNTED + " select p.example_id, coalesce(m, 0)::bigint longest from p left join (select x.example_id, max(len(x.w)) m from x left join y using (example_id, w) where x.n > coalesce(y.n, 0) group by 1) using (example_id)")
def wer_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("example_id", wer.longest_unmatched(F.col("a"), F.col("b")).cast("long").alias("longest"))


@query()
def wer_split_counts(spark: SparkSession, d: str) -> DataFrame:
    return wer.error_counts(_pairs(spark, d), "example_id", "b", "a")


_DAY = f"""with t as (select recorded_at, {comparison_sql('reference')} b, {comparison_sql("list_filter(model_outputs, lambda o: o.name = 'Model H')[1].text")} a from {TASK} where recorded_at is not null)"""


@query(_DAY + f" select strftime(timezone('UTC', recorded_at), '%Y-%m-%d') as day, sum({distance_sql('a', 'b')})::bigint edits, sum(len(b))::bigint reference_tokens from t group by 1")
def stream_windowed_wer(spark: SparkSession, d: str) -> DataFrame:
    """The windowed error rate on the rows at hand; the same call takes a stream."""
    rows = table(spark, d, TASK).where("recorded_at is not null").select("recorded_at", "reference", F.get(F.filter("model_outputs", lambda o: o["name"] == "Model H"), F.lit(0))["text"].alias("heard"))
    return stream.windowed_wer(rows, "recorded_at", "heard", "reference").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "edits", "reference_tokens")


_MODEL_DAY = f"""with o as (select recorded_at, reference, unnest(model_outputs) o from {TASK} where recorded_at is not null),
 t as (select recorded_at, o.name model, {comparison_sql('reference')} b, {comparison_sql('o.text')} a from o where o.name is not null)"""


@query(_MODEL_DAY + f" select model, strftime(timezone('UTC', recorded_at), '%Y-%m-%d') as day, sum({distance_sql('a', 'b')})::bigint edits, sum(len(b))::bigint reference_tokens, sum({distance_sql('a', 'b')}) / nullif(sum(len(b)), 0) wer from t group by 1, 2")
def stream_windowed_wer_models(spark: SparkSession, d: str) -> DataFrame:
    """The windowed error rate of every model, over the utterances it has an output for; one without text is all deletions."""
    rows = table(spark, d, TASK).where("recorded_at is not null").select("recorded_at", "reference", F.explode("model_outputs").alias("o"))
    named = rows.where("o.name is not null").select("recorded_at", "reference", F.col("o.name").alias("model"), F.col("o.text").alias("heard"))
    rates = stream.windowed_wer(named, "recorded_at", "heard", "reference", by=("model",))
    return rates.select("model", F.date_format("start", "yyyy-MM-dd").alias("day"), "edits", "reference_tokens", F.try_divide("edits", "reference_tokens").alias("wer"))


# --- error classes ------------------------------------------------------------------------------------------------


def _classified(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, FINAL).where("not (before <=> reference)").select("example_id", F.col("before").alias("prediction"), "reference")
    return taxonomy.classify(taxonomy.with_metrics(rows))


def _classes_sql() -> str:
    chars = lambda c: f"string_split(replace({c}, ' ', ''), '')"
    digit = lambda c: f"regexp_extract_all(coalesce({c}, ''), '\\p{{Nd}}[\\p{{Nd}},]*')"
    names = ", ".join(f"({k}, {_q(a)}, {_q(b)}, {_q(f)})" for k, (a, b, f) in enumerate(taxonomy.CLASSES))
    return f"""with src as (select example_id id, before prediction, reference from {FINAL} where before is distinct from reference),
 tx as (select id, {spaces_sql('prediction')} p, {spaces_sql('reference')} r, {comparison_sql('prediction')} a, {comparison_sql('reference')} b from src),
 rows as (select id, {tokens_sql('p')} w from tx), {loops_sql('rows')},
 x as (select id, t, count(*) n from (select id, unnest(a) t from tx) group by all), y as (select id, t, count(*) n from (select id, unnest(b) t from tx) group by all),
 ov as (select x.id, sum(least(x.n, y.n)) s from x join y using (id, t) group by 1),
 ur as (select y.id, max(len(t)) m from y left join x using (id, t) where y.n > coalesce(x.n, 0) group by 1), up as (select x.id, max(len(t)) m from x left join y using (id, t) where x.n > coalesce(y.n, 0) group by 1),
 ms as (select src.id example_id, prediction, reference, len(b)::int ref_tokens, len(a)::int pred_tokens, {distance_sql('a', 'b')}::int token_edit_distance,
   ({distance_sql('a', 'b')} / greatest(len(b), 1))::double token_wer_proxy,
   ({distance_sql(chars('p'), chars('r'))} / greatest(len(replace(r, ' ', '')), 1))::double char_edit_ratio, (len(a) / greatest(len(b), 1))::double length_ratio,
   case when len(b) > 0 then coalesce(ov.s, 0) / len(b) else 0.0 end::double overlap_ratio, repeated_token_ratio, max_token_run, max_ngram_repeat,
   {digit('prediction')} <> {digit('reference')} digit_mismatch, coalesce(ur.m, 0)::int max_unmatched_ref_length, coalesce(up.m, 0)::int max_unmatched_pred_length
   from src join tx using (id) join metrics using (id) left join ov using (id) left join ur using (id) left join up using (id)),
 cl as (select *, case when repeated_token_ratio >= 0.18 or max_token_run >= 4 or max_ngram_repeat >= 3 or length_ratio >= 1.55 then 0 when digit_mismatch then 1 when length_ratio <= 0.78 then 2
   when overlap_ratio >= 0.7 and char_edit_ratio <= 0.35 and length_ratio between 0.85 and 1.2 then 3 when overlap_ratio >= 0.45 and greatest(max_unmatched_ref_length, max_unmatched_pred_length) >= 6 then 4
   when overlap_ratio >= 0.35 then 5 else 6 end k from ms),
 nm(k, category, tag, fix) as (values {names}),
 fin as (select cl.* exclude (k), category, tag, fix from cl join nm using (k))"""


_CLASSES = _classes_sql()
_RANKED = " select category, row_number() over (partition by category order by token_wer_proxy desc, example_id) as rank, count(*) over (partition by category) class_size, example_id, token_wer_proxy from fin"


@query(_CLASSES + " select * exclude (fix) from fin")
def taxonomy_classes(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d)


@query(_CLASSES + f" select category, rank::int as rank, example_id, token_wer_proxy from ({_RANKED}) where rank <= 10")
def taxonomy_worst(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.worst(_classified(spark, d), "example_id").select("category", "rank", "example_id", "token_wer_proxy")


@query(_CLASSES + f" select category, rank, class_size, example_id from ({_RANKED})")
def taxonomy_ranked(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.ranked(_classified(spark, d), "example_id").select("category", "rank", "class_size", "example_id")


@query(_CLASSES + " select category, count(*) n, avg(token_wer_proxy) mean_wer from fin group by 1")
def taxonomy_severity(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.severity(_classified(spark, d))


@query(_CLASSES + " select category, n, fix from (select category, count(*) n, any_value(fix) fix, min(example_id) f from fin group by 1) order by n desc, f limit 5")
def taxonomy_top_fixes(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.top_fixes(_classified(spark, d), "example_id")


@query(_CLASSES + f", rk as ({_RANKED}) select category, any_value(tag) tag, any_value(class_size) n, string_agg(example_id::varchar || ':' || token_edit_distance, ' ' order by rank) examples from rk join (select example_id, tag, token_edit_distance from fin) using (example_id) where rank <= 10 group by category")
def taxonomy_structured(spark: SparkSession, d: str) -> DataFrame:
    shown = F.transform("examples", lambda e: F.concat_ws(":", e["index"].cast("string"), e["metrics"]["token_edit_distance"].cast("string")))
    return taxonomy.structured(_classified(spark, d), "example_id").select("category", "tag", "n", F.array_join(shown, " ").alias("examples"))


@query()
def taxonomy_demo(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.demo(_classified(spark, d), "example_id")


@query()
def taxonomy_demo_summary(spark: SparkSession, d: str) -> DataFrame:
    return taxonomy.demo_summary(taxonomy_demo(spark, d))


# --- samples ------------------------------------------------------------------------------------------------------


@query(f"with t as (select example_id, row_number() over (order by example_id) rn, count(*) over () n from {FINAL} where before is distinct from reference) select example_id from t where (rn - 1) % greatest(1, n // 25) = 0 order by rn limit 25")
def sample_stride(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stride_sample(table(spark, d, FINAL).where("not (before <=> reference)").select("example_id"), "example_id")


@query(f"with t as (select doc_id, row_number() over (order by n_chars, doc_id) rn, count(*) over () n from {DOCS} where n_chars is not null) select doc_id, least(3, (rn - 1) * 4 // n)::int stratum from t")
def sample_strata(spark: SparkSession, d: str) -> DataFrame:
    return sampling.strata(table(spark, d, DOCS).where("n_chars is not null").select("doc_id", "n_chars"), "n_chars", "doc_id").select("doc_id", "stratum")


_KEY_OF = "md5({0}::varchar || ':42')"
_QUOTA_OF = f"""u as (select *, {_KEY_OF.format('doc_id')} h, row_number() over (order by n_chars, doc_id) rn, count(*) over () n from src),
 s as (select *, least(3, (rn - 1) * 4 // n)::int stratum from u), c as (select stratum, count(*) k, any_value(n) n from s group by 1),
 -- quotas one stratum after the other: its share, at least one, leaving one for each later stratum
 q0 as (select k, n, least(k, greatest(1, 500 - 3), greatest(1, round_even(500 * k / n, 0))) take from c where stratum = 0),
 q1 as (select c.k, least(c.k, greatest(1, 500 - q0.take - 2), greatest(1, round_even(500 * c.k / c.n, 0))) take from c, q0 where stratum = 1),
 q2 as (select c.k, least(c.k, greatest(1, 500 - q0.take - q1.take - 1), greatest(1, round_even(500 * c.k / c.n, 0))) take from c, q0, q1 where stratum = 2),
 q3 as (select c.k, least(c.k, greatest(1, 500 - q0.take - q1.take - q2.take), greatest(1, round_even(500 * c.k / c.n, 0))) take from c, q0, q1, q2 where stratum = 3),
 q as (select 0 stratum, take from q0 union all select 1, take from q1 union all select 2, take from q2 union all select 3, take from q3),
 r as (select s.*, take, row_number() over (partition by s.stratum order by h, doc_id) r from s join q using (stratum))"""
_QUOTA = f"with src as (select doc_id, n_chars from {DOCS} where n_chars is not null), {_QUOTA_OF}"


@query(_QUOTA + " select doc_id, n_chars, case when n <= 500 then null else stratum end stratum from r order by n > 500 and r <= take desc, h, doc_id limit 500")
def sample_stratified(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified_sample(table(spark, d, DOCS).where("n_chars is not null").select("doc_id", "n_chars"), "n_chars", "doc_id", 500)


@query(f"select sample_id, word from {Q3} where confidence = 'low' order by {_KEY_OF.format('sample_id')}, sample_id limit 50")
def sample_hash(spark: SparkSession, d: str) -> DataFrame:
    return sampling.hash_sample(table(spark, d, Q3).where("confidence = 'low'").select("sample_id", "word"), "sample_id", 50)


@query(f"with t as (select row_idx, row_number() over (order by {_KEY_OF.format('row_idx')}, row_idx) rn, count(*) over () n from {TASK}) select row_idx, case when rn <= greatest(1, least(n - 1, round_even(n * 0.1, 0))) then 'validation' else 'train' end fold from t")
def sample_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.split(table(spark, d, TASK).select("row_idx"), "row_idx")


@query(f"select example_id, before from {FINAL} order by example_id limit 100")
def sample_head(spark: SparkSession, d: str) -> DataFrame:
    return sampling.head(table(spark, d, FINAL).select("example_id", "before"), "example_id")


@query(f"select (row_number() over (order by example_id) - 1) // 8 batch, example_id from {FINAL}")
def sample_batches(spark: SparkSession, d: str) -> DataFrame:
    return sampling.batches(table(spark, d, FINAL).select("example_id"), "example_id")


@query(_GATE + " select row_idx, normalized_text from g where drop_reason is null order by row_idx limit 200")
def quality_first_valid(spark: SparkSession, d: str) -> DataFrame:
    return quality.first_valid(_gated(spark, d), "row_idx").select("row_idx", "normalized_text")


@query(_GATE + f", src as (select row_idx doc_id, len(normalized_text) n_chars, normalized_text from g where drop_reason is null), {_QUOTA_OF} select doc_id row_idx, printf('segment_%06d.wav', doc_id) audio_path, normalized_text as text from r order by n > 500 and r <= take desc, h, doc_id limit 500")
def training_set(spark: SparkSession, d: str) -> DataFrame:
    return quality.training_set(_gated(spark, d), "row_idx", 500)


# --- spelling -----------------------------------------------------------------------------------------------------


def _lexicon(spark: SparkSession, d: str) -> DataFrame:
    """The listed words: those ever suggested."""
    return spelling.lexicon_of(table(spark, d, Q3), "suggestion")


def _forms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, Q3).select(text.normalize_word(F.col("normalized_word")).alias("w")).distinct()


_W = f"with w as (select distinct {word_sql('normalized_word')} w from {Q3}), lex as (select distinct {word_sql('suggestion')} entry from {Q3} where suggestion is not null)"
_DEP = r"\x{93A}-\x{93C}\x{93E}-\x{94F}\x{955}-\x{957}\x{962}\x{963}"
_ISSUES = [
    ("only_digits", r"regexp_matches(w, '\p{Nd}') and not regexp_matches(w, '[\x{900}-\x{97F}]') and not regexp_matches(w, '[A-Za-z]')"),
    ("mixed_script_noise", r"regexp_matches(w, '[\x{900}-\x{97F}]') and regexp_matches(w, '[A-Za-z]')"),
    ("no_letters", r"not regexp_matches(w, '[\x{900}-\x{97F}]') and not regexp_matches(w, '[A-Za-z]')"),
    ("marks_only_token", f"regexp_matches(w, '^[{_DEP}]+$')"),
    ("leading_dependent_mark", f"regexp_matches(w, '^[{_DEP}]')"),
    ("trailing_halant", r"regexp_matches(w, '\x{94D}$')"),
    ("double_halant", r"regexp_matches(w, '\x{94D}{2,}')"),
    ("consecutive_matras", r"regexp_matches(w, '[\x{93E}-\x{94C}]{2,}')"),
    ("repeated_diacritic", f"regexp_matches(w, '{pairs_sql(''.join(map(chr, [*range(0x93A, 0x958), 0x962, 0x963])), 2)}')"),
    ("repeated_character_noise", f"regexp_matches(w, '{pairs_sql(DEVANAGARI + 'abcdefghijklmnopqrstuvwxyz0123456789', 3)}')"),
    ("suspicious_nukta_usage", r"regexp_matches(w, '\x{93C}.*\x{93C}|^\x{93C}')"),
]


@query(_W + " select w, case when w = '' then 'empty_after_normalization' else array_to_string(list_filter([" + ", ".join(f"case when {c} then '{n}' end" for n, c in _ISSUES) + "], lambda x: x is not null), ',') end issues from w")
def spelling_issues(spark: SparkSession, d: str) -> DataFrame:
    return _forms(spark, d).select("w", F.array_join(spelling.issues(F.col("w")), ",").alias("issues"))


_SUFFIXES = ", ".join(f"({k}, {_q(s)})" for k, s in enumerate(["", *spelling.SUFFIXES]))


@query(_W + f", s(k, s) as (values {_SUFFIXES}) select w, arg_min(lex.entry, k) stem from w join s on (s = '' or (ends_with(w, s) and len(w) > len(s) + 1)) join lex on lex.entry = w[1:len(w) - len(s)] group by w")
def spelling_stems(spark: SparkSession, d: str) -> DataFrame:
    return spelling.stems(_forms(spark, d), _lexicon(spark, d))


_BYTES_FROM = "".join(map(chr, [*range(0x901, 0x904), *range(0x905, 0x915), *range(0x915, 0x93A), 0x93C, *range(0x93E, 0x94E), *range(0x964, 0x970)]))
_BYTES_TO = "".join(chr(c) for c in range(1, 128) if not chr(c).isalnum() and chr(c) != "'") + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _bytes(c: str) -> str:
    return f"translate({c}, {_q(_BYTES_FROM)}, {_q(_BYTES_TO[: len(_BYTES_FROM)])})"


@query(_W + f""", n as (select w, entry, levenshtein({_bytes('w')}, {_bytes('entry')}) k from w join lex on abs(len(w) - len(entry)) <= 2 where w <> ''),
 b as (select w, min(k) k from n where k <= 2 group by w) select w, min(entry) candidate, any_value(b.k)::int distance from n join b using (w) where n.k = b.k group by w""")
def spelling_nearest(spark: SparkSession, d: str) -> DataFrame:
    return spelling.nearest(_forms(spark, d), _lexicon(spark, d))


def _sound_sql(c: str) -> str:
    a = "".join(k for k, _ in similarity.SOUND_CLASSES) + similarity.SILENT
    return f"translate({c}, {_q(a)}, {_q(''.join(v * len(k) for k, v in similarity.SOUND_CLASSES))})"


@query(_W + f", k as (select w, {_sound_sql('w')} s from w where w <> ''), l as (select entry, {_sound_sql('entry')} t from lex),"
    f" c as (select w, entry, levenshtein({_bytes('w')}, {_bytes('entry')}) e from k join l on (s = t or w[1] = entry[1]) and s <> '' and t <> '' and levenshtein({_bytes('s')}, {_bytes('t')}) <= 1)"
    " select w, arg_min(entry, (e, entry)) candidate from c where e <= 1 group by w")
def spelling_phonetic(spark: SparkSession, d: str) -> DataFrame:
    return spelling.phonetic_match(_forms(spark, d), _lexicon(spark, d))


@query(_W + f""" select w, {_sound_sql('w')} sound, regexp_replace(w, '[{_DEP}]', '', 'g') skeleton, regexp_replace(w, '[^{similarity.MATRAS}]', '', 'g') matras,
 regexp_matches(w, '[\\x{{900}}-\\x{{97F}}]') and not regexp_matches(w, '[A-Za-z]') devanagari, regexp_matches(w, '[A-Za-z]') and not regexp_matches(w, '[\\x{{900}}-\\x{{97F}}]') roman from w""")
def spelling_keys(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("w")
    return _forms(spark, d).select("w", similarity.sound_key(w).alias("sound"), similarity.skeleton(w).alias("skeleton"), similarity.matra_signature(w).alias("matras"), text.is_devanagari_token(w).alias("devanagari"), text.is_roman_token(w).alias("roman"))


_KEY = "translate(coalesce((select max(n) from (values " + ", ".join(f"({_q(a)}, {_q(b)})" for a, b in similarity.NUMBER_FORMS) + ") v(w2, n) where v.w2 = d), d), 'ँ़', 'ं')"


@query(_W + f", k as (select w, translate(w, '{text.DEVANAGARI_DIGITS}', '0123456789') d from w) select w, {_KEY} as key from k")
def similarity_keys(spark: SparkSession, d: str) -> DataFrame:
    return _forms(spark, d).select("w", similarity.comparison_key(F.col("w")).alias("key"))


def _rough_sql(c: str) -> str:
    kept = f"string_split(regexp_replace({c}, '{similarity.MATRA_RANGE}', '', 'g'), '')"
    return f"array_to_string(list_filter({kept}, lambda x, i: i = 1 or x <> ({kept})[i - 1]), '')"


def _matra_sql(a: str, b: str) -> str:
    sk, mt = (lambda c: f"regexp_replace({c}, '[{_DEP}]', '', 'g')"), (lambda c: f"regexp_replace({c}, '[^{similarity.MATRAS}]', '', 'g')")
    return f"({a} <> '' and {b} <> '' and {a} <> {b} and {sk(a)} = {sk(b)} and {mt(a)} <> {mt(b)})"


@query(f"""with p as (select sample_id, {word_sql('word')} a, {word_sql('suggestion')} b from {Q3} where suggestion is not null),
 k as (select *, (select {_KEY} from (select translate(a, '{text.DEVANAGARI_DIGITS}', '0123456789') d)) x, (select {_KEY} from (select translate(b, '{text.DEVANAGARI_DIGITS}', '0123456789') d)) y, {_sound_sql('a')} s, {_sound_sql('b')} t from p)
 select sample_id, a <> '' and b <> '' and (x = y or {_rough_sql('x')} = {_rough_sql('y')} or (least(len(a), len(b)) > 2 and levenshtein({_bytes('a')}, {_bytes('b')}) <= 2)) "similar",
 s <> '' and t <> '' and levenshtein({_bytes('s')}, {_bytes('t')}) <= 1 sounds_like, {_matra_sql('a', 'b')} matra_error from k""")
def similarity_pairs(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, Q3).where("suggestion is not null").select("sample_id", text.normalize_word(F.col("word")).alias("a"), text.normalize_word(F.col("suggestion")).alias("b"))
    return q.select("sample_id", similarity.similar(F.col("a"), F.col("b")).alias("similar"), similarity.sounds_like(F.col("a"), F.col("b")).alias("sounds_like"), similarity.matra_error(F.col("a"), F.col("b")).alias("matra_error"))


def _cascade_sql() -> str:
    found = "case when w = '' then ['empty_after_normalization'] else list_filter([" + ", ".join(f"case when {c} then '{n}' end" for n, c in _ISSUES) + "], lambda x: x is not null) end"
    words = lambda ws: ", ".join(map(_q, ws))
    dev, lat = r"regexp_matches(w, '[\x{900}-\x{97F}]')", "regexp_matches(w, '[A-Za-z]')"
    hard = f"list_has_any(found, [{words(spelling.HARD)}])"
    two = "array_to_string(found[1:2], ', ')"
    strong = f"regexp_full_match(w, {_q(english.ROMAN_WORD)}) or w in ({words(spelling.BORROWED)})"
    return f"""with r as (select sample_id, word, {word_sql('word')} w from {Q3}), ws as (select distinct w from r),
 lex as (select distinct {word_sql('suggestion')} entry from {Q3} where suggestion is not null and {word_sql('suggestion')} <> ''),
 b as (select w, {found} found, entry is not null listed, case when {strong} then 'strong' when entry is not null then null when regexp_matches(w, '{"|".join(spelling.HINTS)}') then 'medium' end english from ws left join lex on lex.entry = w),
 o as (select w from b where english is null and not listed and w <> ''),
 sf(k, s) as (values {_SUFFIXES}),
 st as (select w, arg_min(lex.entry, k) stem from o join sf on (s = '' or (ends_with(w, s) and len(w) > len(s) + 1)) join lex on lex.entry = w[1:len(w) - len(s)] group by w),
 nr as (select w, arg_min(entry, (k, entry)) cand, min(k) dist from (select w, entry, levenshtein({_bytes('w')}, {_bytes('entry')}) k from (select w from o where w not in (select w from st)) join lex on abs(len(w) - len(entry)) <= 2) where k <= 2 group by w),
 a as (select b.*, stem, cand, dist from b left join st using (w) left join nr using (w)),
 c as (select *, case when w = '' then 'invalid_pattern' when english = 'strong' and regexp_full_match(w, '[\\x{{00}}-\\x{{7F}}]*') then 'roman_english' when english = 'strong' then 'devanagari_english_strong'
  when english = 'medium' then 'devanagari_english_medium' when listed then 'exact_dictionary' when stem is not null then 'inflected_dictionary' when {hard} then 'invalid_pattern'
  when coalesce({_matra_sql('w', 'cand')}, false) then 'matra_match' when cand is not null then 'near_dictionary_match' when {dev} and not {lat} then 'plausible_unknown' else 'unknown_suspicious' end source from a),
 d as (select w, source, case when source in ('invalid_pattern', 'matra_match', 'near_dictionary_match', 'unknown_suspicious') then 'incorrect_spelling' else 'correct_spelling' end label,
  case when source in ('exact_dictionary', 'roman_english', 'devanagari_english_strong') then 'high' when source in ('inflected_dictionary', 'devanagari_english_medium', 'matra_match') or (source = 'near_dictionary_match' and dist <= 1) then 'medium' else 'low' end confidence,
  case source when 'exact_dictionary' then 'Exact match in curated Hindi lexicon.' when 'inflected_dictionary' then 'Matches a common Hindi stem: ' || stem || '.' when 'roman_english' then 'Roman-script English token, treated as correctly spelled.'
   when 'devanagari_english_strong' then 'Recognized Devanagari spelling of an English borrowing.' when 'devanagari_english_medium' then 'Likely Devanagari form of an English word.'
   when 'near_dictionary_match' then 'Edit distance match with common Hindi word ' || chr(39) || cand || chr(39) || '.' when 'matra_match' then 'Likely matra/diacritic variant of ' || chr(39) || cand || chr(39) || '.'
   when 'invalid_pattern' then 'Suspicious Hindi character pattern: ' || case when {two} = '' then 'invalid orthographic pattern' else {two} end || '.'
   when 'plausible_unknown' then 'Ambiguous form: plausible Hindi spelling but outside curated lexicon.'
   else 'Unknown token with ambiguous or noisy spelling: ' || case when {two} = '' then 'unknown form' else {two} end || '.' end reason, cand suggestion from c),
 fin as (select sample_id, word, w normalized_form, case when z then 'incorrect_spelling' else label end label, case when z then 'invalid_pattern' else source end source, case when z then 'low' else confidence end confidence,
  case when z then 'Suspicious Hindi character pattern: punctuation_contamination.' else reason end reason, case when not z then suggestion end suggestion from (select *, coalesce(regexp_matches(word, '[.,;:!?/\\\\|*_]'), false) z from r join d using (w)))"""


_CASCADE = _cascade_sql()


@query(_CASCADE + " select * from fin")
def spelling_cascade(spark: SparkSession, d: str) -> DataFrame:
    return spelling.classify(table(spark, d, Q3).select("sample_id", "word"), "word", _lexicon(spark, d))


@query(_CASCADE + " select label, confidence, source, count(*) n from fin group by all")
def spelling_cascade_counts(spark: SparkSession, d: str) -> DataFrame:
    return spelling.counts(spelling_cascade(spark, d), "label", "confidence", "source")


@query(f"select label, confidence, count(*) n from {Q3} group by all")
def spelling_counts(spark: SparkSession, d: str) -> DataFrame:
    return spelling.counts(table(spark, d, Q3), "label", "confidence")


@query(f"select source, count(*) n from {Q3} group by all")
def spelling_source_counts(spark: SparkSession, d: str) -> DataFrame:
    return spelling.counts(table(spark, d, Q3), "source")


@query(f"select sample_id, word, replace(label, '_', ' ') as label from {Q3} where confidence = 'low'")
def spelling_low_confidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, Q3).where("confidence = 'low'").select("sample_id", "word", F.replace("label", F.lit("_"), F.lit(" ")).alias("label"))


_AUDIT = f"with r as (select *, first_value(label) over (partition by recording_id, normalized_word order by logged_at, sample_id) manual from {Q3})"


def _reviewed(spark: SparkSession, d: str) -> DataFrame:
    """Decisions with the label of the first decision on the same word of the recording as the reviewed one."""
    from pyspark.sql import Window

    w = Window.partitionBy("recording_id", "normalized_word").orderBy("logged_at", "sample_id")
    return table(spark, d, Q3).withColumn("manual", F.first("label").over(w))


@query(_AUDIT + """ select count(*) annotated, count(*) filter (label = manual) system_right, count(*) - count(*) filter (label = manual) system_wrong, round_even(count(*) filter (label = manual) / count(*), 4) accuracy,
 count(*) filter (label = 'correct_spelling') predicted_correct, count(*) - count(*) filter (label = 'correct_spelling') predicted_incorrect, count(*) filter (manual = 'correct_spelling') manual_correct, count(*) - count(*) filter (manual = 'correct_spelling') manual_incorrect from r""")
def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    return spelling.audit(_reviewed(spark, d), "label", "manual")


_KIND = """case when coalesce(regexp_matches(word, '[,.;:|]'), false) or contains(lower(coalesce(reason, '')), 'punctuation') then 'punctuation_or_tokenization_noise'
 when contains(lower(coalesce(reason, '')), 'english') or coalesce(source in ('roman_english', 'devanagari_english_strong', 'devanagari_english_medium'), false) then 'code_mixed_or_borrowed_words'
 when manual = 'correct_spelling' and label = 'incorrect_spelling' and (contains(lower(coalesce(reason, '')), 'edit distance') or contains(lower(coalesce(reason, '')), 'match')) then 'over_aggressive_near_match_rules'
 when manual = 'correct_spelling' and label = 'incorrect_spelling' then 'rare_valid_words_outside_lexicon' when manual = 'incorrect_spelling' and label = 'correct_spelling' then 'plausible_but_wrong_forms'
 when coalesce(source = 'matra_match', false) or contains(lower(coalesce(reason, '')), 'matra') or contains(lower(coalesce(reason, '')), 'diacritic') then 'matra_or_orthographic_variation' else 'other_ambiguous_forms' end"""


@query(_AUDIT + f", f as (select *, {_KIND} kind from r where label <> manual), g as (select kind, count(*) over (partition by kind) n, row_number() over (partition by kind order by sample_id)::int as rank, sample_id as index, word from f) select kind, n, rank, index, word from g where rank <= 10")
def audit_failures(spark: SparkSession, d: str) -> DataFrame:
    return spelling.failures(_reviewed(spark, d).withColumn("note", F.lit(None).cast("string")), "sample_id", predicted="label", manual="manual", note="note")


@query(_AUDIT + f""", f as (select *, {_KIND} kind from r where label <> manual), g as (select kind, count(*) over (partition by kind) n, row_number() over (partition by kind order by sample_id) rk, word from f),
 w(kind, why) as (values {", ".join(f"({_q(a)}, {_q(b)})" for a, b in spelling.WHY)})
 select kind, n, why, string_agg(coalesce(word, '?'), '|' order by rk) words from g join w using (kind) where rk <= 5 group by kind, n, why order by n desc, kind limit 2""")
def audit_unreliable(spark: SparkSession, d: str) -> DataFrame:
    found = spelling.unreliable(audit_failures(spark, d))
    return found.withColumn("words", F.array_join("words", "|", "?"))


@query(_AUDIT + """, a as (select round_even(count(*) filter (label = manual) / count(*), 4) accuracy from r)
 select accuracy, case when accuracy >= 0.75 then 'reasonably_useful' when accuracy >= 0.5 then 'ambiguous' else 'unreliable' end code from a""")
def audit_takeaway(spark: SparkSession, d: str) -> DataFrame:
    return audit_summary(spark, d).select("accuracy", spelling.takeaway(F.col("accuracy"))["code"].alias("code"))


@query(f"select (case label when 'correct_spelling' then 0 when 'incorrect_spelling' then 1 else 2 end * 4 + case confidence when 'high' then 0 when 'medium' then 1 when 'low' then 2 else 3 end)::int place, label, confidence, count(*) n from {Q3} group by all")
def spelling_ordered_counts(spark: SparkSession, d: str) -> DataFrame:
    return spelling.ordered_counts(table(spark, d, Q3))


# --- lattice ------------------------------------------------------------------------------------------------------


def _lattices(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, TASK)
    cores = spark.sparkContext.defaultParallelism
    return lattice.lattices(t if t.rdd.getNumPartitions() >= cores else t.repartition(cores))


@query()
def lattice_bins(spark: SparkSession, d: str) -> DataFrame:
    return _lattices(spark, d).select("utterance_id", "n_bins", F.to_json("bins").alias("bins"), F.to_json("aligned").alias("aligned"))


@query()
def lattice_overrides(spark: SparkSession, d: str) -> DataFrame:
    return _lattices(spark, d).where(F.size("overrides") > 0).select("utterance_id", "segment_url", F.to_json("overrides").alias("overrides"))


@query()
def lattice_scores(spark: SparkSession, d: str) -> DataFrame:
    return lattice.model_scores(_lattices(spark, d))


@query()
def lattice_comparison(spark: SparkSession, d: str) -> DataFrame:
    return lattice.comparison(lattice.model_scores(_lattices(spark, d)))


@query()
def lattice_summary(spark: SparkSession, d: str) -> DataFrame:
    return lattice.summary(_lattices(spark, d))


@query()
def lattice_improved(spark: SparkSession, d: str) -> DataFrame:
    return lattice.improved_cases(lattice.model_scores(_lattices(spark, d)))


@query()
def lattice_improved_counts(spark: SparkSession, d: str) -> DataFrame:
    return lattice.improved_counts(lattice.model_scores(_lattices(spark, d)))


@query()
def lattice_long(spark: SparkSession, d: str) -> DataFrame:
    """Rates as one row per model and kind, for plotting."""
    return lattice_comparison(spark, d).unpivot(["model", "delta"], ["baseline_wer", "lattice_wer"], "kind", "wer").orderBy("delta", "model", "kind")


@query(f"select lang, kind, value from (select lang, count(*)::double documents, avg(n_chars)::double mean_chars from {DOCS} where lang is not null group by lang) unpivot (value for kind in (documents, mean_chars))")
def report_long(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, DOCS).where("lang is not null").groupBy("lang").agg(F.count("*").cast("double").alias("documents"), F.avg("n_chars").alias("mean_chars"))
    return g.unpivot(["lang"], ["documents", "mean_chars"], "kind", "value")


@query(f"select count(*) rows, count(*) filter (raw_prediction is not null) predicted, count(*) filter (raw_prediction is distinct from normalized) normalized_rows, count(*) filter (contains(tagged, '[EN]')) tagged_rows from {Q2}")
def report_run_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, Q2).agg(F.count("*").alias("rows"), F.count("raw_prediction").alias("predicted"), F.count_if(~F.col("raw_prediction").eqNullSafe(F.col("normalized"))).alias("normalized_rows"), F.count_if(F.contains("tagged", F.lit("[EN]"))).alias("tagged_rows"))
