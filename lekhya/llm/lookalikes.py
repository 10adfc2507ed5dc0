"""Problem 4: text that looks the same but is stored in other characters.

Texts are mapped to one form of every look-alike letter and sequence, full-width form and kind of space, and
grouped in SQL under an accent-sensitive, case-sensitive Unicode collation, which takes composed and decomposed
marks as equal and invisible characters as absent. Each class gets a deterministic canonical member (the stored
text nearest to its mapped form, then the smallest), which is joined back. Only texts that share their base letters
with another one of their group can have a twin; the collation, which is dear, sees no others.

The collation also equates digits of different scripts, which don't look the same; the mapped form's digits are
therefore part of the class. Nulls (in the group or any text) belong to no class. Empty texts form a class of their
own. Texts are compared whole; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lekhya.llm.forms import look_form, rough_form
from lekhya.llm.run import cut

COLLATION = "UNICODE"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9\\u0660-\\u0669\\u06F0-\\u06F9\\u0966-\\u096F]+", "")


def variants(df: DataFrame, group_col: str, texts: list[str]) -> DataFrame:
    """Distinct stored texts of a group with their class: g, t0.., c0.. (canonical member), n_forms of the class."""
    one = df.select(F.col(group_col).alias("g"), *[F.col(t).alias(f"t{i}") for i, t in enumerate(texts)]).dropna()
    names = [f"t{i}" for i in range(len(texts))]
    forms = one.groupBy("g", *names).agg(F.count("*").alias("n"))
    forms = forms.select("*", *[look_form(F.col(t)).alias(f"m{t[1:]}") for t in names])
    forms = forms.withColumn("rough", F.xxhash64("g", *[rough_form(F.col(f"m{t[1:]}")) for t in names]))
    shared = forms.groupBy("rough").agg(F.count("*").alias("k")).where("k > 1").select("rough")
    # used twice from here on: written once
    forms = cut(forms.join(shared, "rough", "left_semi").drop("rough").select("*", *[_digits(F.col(f"m{t[1:]}")).alias(f"d{t[1:]}") for t in names]))
    ix = range(len(texts))
    keys = ", ".join([f"collate(m{i}, '{COLLATION}')" for i in ix] + [f"d{i}" for i in ix])
    far = " + ".join(f"if(t{i} = m{i}, 0, 1 + length(t{i}))" for i in ix)
    named = ", ".join([f"collate(m{i}, '{COLLATION}') as k{i}" for i in ix] + [f"d{i} as e{i}" for i in ix])
    classes = df.sparkSession.sql(
        f"""select g as h, {named}, count(*) as n_forms, min(struct({far} as far, {', '.join(names)})) as canon
            from {{forms}} group by g, {keys} having count(*) > 1""",
        forms=forms,
    )
    on = " and ".join(["f.g = c.h"] + [f"collate(f.m{i}, '{COLLATION}') = c.k{i} and f.d{i} = c.e{i}" for i in ix])
    return df.sparkSession.sql(
        f"select f.g, {', '.join('f.' + t for t in names)}, {', '.join(f'c.canon.t{i} as c{i}' for i in ix)}, c.n_forms from {{f}} f join {{c}} c on {on}",
        f=forms,
        c=classes,
    )


def consistent(df: DataFrame, id_col: str, group_col: str, texts: list[str]) -> DataFrame:
    """Rows whose text has twins stored otherwise: id_col, group_col, canonical_<text>.., n_forms of the class."""
    v = variants(df, group_col, texts)
    rows = df.select(F.col(id_col).alias("id"), F.col(group_col).alias("g"), *[F.col(t).alias(f"t{i}") for i, t in enumerate(texts)])
    joined = rows.join(v, ["g", *[f"t{i}" for i in range(len(texts))]])
    return joined.select(F.col("id").alias(id_col), F.col("g").alias(group_col), *[F.col(f"c{i}").alias(f"canonical_{t}") for i, t in enumerate(texts)], "n_forms")


def consistent_all(df: DataFrame, id_col: str, group_col: str, texts: list[str], takes_part: Column | None = None) -> DataFrame:
    """Every row in one form: id_col, group_col, canonical_<text>.., n_forms of the class.

    A null looks like nothing but a null. Rows without a twin stored otherwise, without a group or that take no part
    come out in their own mapped form, with n_forms 1."""
    names = [f"t{i}" for i in range(len(texts))]
    nulls = [F.col(t).isNull().alias(f"z{i}") for i, t in enumerate(texts)]
    sound = F.col(group_col).isNotNull() if takes_part is None else F.col(group_col).isNotNull() & takes_part
    rows = df.select(
        F.col(id_col).alias("id"),
        F.col(group_col).alias("own"),
        F.when(sound, F.struct(F.col(group_col).alias("own"), *nulls)).alias("g"),
        *nulls,
        *[F.coalesce(F.col(t), F.lit("")).alias(n) for n, t in zip(names, texts)],
    )
    joined = rows.join(variants(rows, "g", names), ["g", *names], "left")
    forms = [F.when(~F.col(f"z{i}"), F.coalesce(F.col(f"c{i}"), look_form(F.col(f"t{i}")))).alias(f"canonical_{t}") for i, t in enumerate(texts)]
    return joined.select(F.col("id").alias(id_col), F.col("own").alias(group_col), *forms, F.coalesce("n_forms", F.lit(1).cast("long")).alias("n_forms"))


def pairs(df: DataFrame, id_col: str, group_col: str, texts: list[str]) -> DataFrame:
    """Pairs id_a < id_b of rows of one class whose stored texts differ.

    Rows meet through their class's canonical member; only classes of two or more stored forms come so far, and
    adaptive execution splits a hot class."""
    names = [f"t{i}" for i in range(len(texts))]
    v = variants(df, group_col, texts)
    rows = df.select(F.col(id_col).alias("id"), F.col(group_col).alias("g"), *[F.col(t).alias(f"t{i}") for i, t in enumerate(texts)])
    members = cut(rows.join(v, ["g", *names]).select("id", "g", F.struct(*names).alias("t"), F.struct(*[f"c{i}" for i in range(len(texts))]).alias("c")))
    a = members.select("g", "c", F.col("id").alias("id_a"), F.col("t").alias("ta"))
    b = members.select("g", "c", F.col("id").alias("id_b"), F.col("t").alias("tb"))
    return a.join(b, ["g", "c"]).where("id_a < id_b and ta <> tb").select("id_a", "id_b")
