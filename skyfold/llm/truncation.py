"""Texts that were cut off before their end."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.functions.text import strip
from skyfold.operators.skew import broadcast_checked, salted_join
from skyfold.session import materialize, spread

_CLOSERS = "\"”’')\\]»}"
_STOPS = ".!?…。！？"
# A stop that ends a token becomes ⓢ, a line break ⓝ; other marks at the edges of a token vanish, numbers are all 0.
# Runs are tried from their first character only, so that long ones cost no more than their length; the first
# character or look-ahead of a pattern is the cheap test that fails at most places.
_STEPS = [
    (r"([\x{3040}-\x{30ff}\x{3400}-\x{9fff}])", " $1 "),
    (r" (?<!  ) *+([。！？、」])", "$1 "),
    (r"[0-9]++(?:[.,:/][0-9]++)*+", "0"),
    (r"[ \n](?<! [ \n])(?:(?<=\n)| *+\n)[\n ]*+", "ⓝ "),
    (rf"(?=[.,;:!?…。！？、—{_CLOSERS}])(?<![.,;:!?…。！？、—{_CLOSERS}])[.,;:!?…。！？、—{_CLOSERS}]*[{_STOPS}][{_CLOSERS}]*+(?=ⓝ?+(?: |\z))", "ⓢ"),
    (rf"(?=[.,;:、—({_CLOSERS}])(?<![.,;:、—({_CLOSERS}])[.,;:、—({_CLOSERS}]++(?=ⓝ?+(?: |\z))", ""),
    (r"(?=[\"“'(¿¡«\[])(?<![^ ])[\"“'(¿¡«\[]++", ""),
    (r" (?<!  ) *+(?=[ⓢⓝ])", ""),
]
# All white space of Unicode becomes a plain space or line break first, so that the patterns need no Unicode classes.
_SPACES, _BREAKS = "\t\x0b\x0c\x1c\x1d\x1e\x1f\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000", "\r\x85\u2028\u2029"


def _plain(text: str) -> str:
    """SQL of a text in lower case, all its white space being spaces and line breaks."""
    return f"translate(lower({text}), '{_SPACES}{_BREAKS}', '{' ' * len(_SPACES)}{chr(10) * len(_BREAKS)}')"


def _marked(plain: str) -> str:
    """SQL of a plain text with its tokens normalised and stops marked."""
    quoted = [(pattern.replace("\\", "\\\\").replace("'", "\\'"), by) for pattern, by in _STEPS]
    replaced = lambda sql, steps: reduce(lambda s, step: f"regexp_replace({s}, '{step[0]}', '{step[1]}')", steps, sql)
    # the steps for scripts without spaces have nothing to do in texts of ASCII
    parted = f"if(octet_length({plain}) = char_length({plain}), {plain}, {replaced(plain, quoted[:2])})"
    return f"trim({replaced(parted, quoted[2:])})"


def _tokens(marked: str) -> str:
    return f"filter(split({marked}, ' '), t -> t != '')"


# Runs are tried from their first character only, so that long ones cost no more than their length.
_GROUPS = r"(?U)(?<!\\s)(?:\\s*+[\\[(][^\\[\\]()]{1,40}+[\\])])++\\s*+$"
_CLOSED = "(?<![\"”’\\')\\\\]»}])[\"”’\\')\\\\]»}]++$"
_CLOSER_LIST = "\"”’\\')]»}"
# Words that are looked at for a text's end, twice as many as a line is compared by; where white space or marks in
# long runs leave fewer than that without the margin, the whole text is.
_TAIL = 16
_MOST_RATIO = 200  # no trigram, however common, counts for more
_UNCLOSED = r"[\\[(][^\\[\\]()]{0,40}$"
_MARK = r"(?U)(?<!\\s)(?:\\s*+(?:\\.\\.\\.|…|\\x{fffd}))++\\s*+$"


def _sql(of: DataFrame | SparkSession, query: str, **frames: DataFrame) -> DataFrame:
    """The query's result; «name» stands for a given frame (braces are left to the patterns)."""
    spark = of if isinstance(of, SparkSession) else of.sparkSession
    query = query.replace("{", "{{").replace("}", "}}")
    for name in frames:
        query = query.replace(f"«{name}»", f"{{{name}}}")
    return spark.sql(query, **frames)


def _counts(texts: DataFrame) -> DataFrame:
    """Word trigrams of all texts: how often they go on, stop (sentence or line), stop at a line's end, end a text.

    Rows without w1 and w2 count beginnings of lines instead, of up to eight words (w3), that go on or stop there.
    """
    return _sql(
        texts,
        """
        with g as (select inline(concat(
            transform(tokens, (t, i) -> struct(coalesce(get(words, i - 2), '^') as w1, coalesce(get(words, i - 1), '^') as w2,
              words[i] as w3, contains(t, 'ⓢ') as stop, contains(t, 'ⓝ') as line, i = size(tokens) - 1 as final)),
            flatten(transform(filter(transform(split(translate(marked, 'ⓢ', ''), 'ⓝ'), l -> filter(split(l, ' '), t -> t != '')), l -> size(l) > 0), l ->
              transform(sequence(1, least(8, size(l))), k -> struct(string(null) as w1, string(null) as w2, array_join(slice(l, 1, k), ' ') as w3, k = size(l) as stop, false as line, false as final))))
            )) from «texts»)
        select w1, w2, w3, count_if(not final and not (stop or line)) as goes_on, count_if(stop or (not final and line)) as stops, count_if(not final and line) as line_ends, count_if(final) as text_ends
        from g group by 1, 2, 3
        """,
        texts=texts,
    )


def _extensions(counts: DataFrame, finals: DataFrame, context: list[str], name: str) -> DataFrame:
    """How often a longer word that begins with a final word follows the same context inside texts."""
    c, spark = ", ".join(context), counts.sparkSession
    lengths = _sql(spark, f"select {c}, collect_set(length(w3)) as lengths from «finals» group by {c}", finals=finals)
    grown = _sql(spark, f"select {c}, w3, sum(goes_on + stops + text_ends) as n from «counts» group by {c}, w3", counts=counts)
    cut = _sql(
        spark,
        f"select {c}, left(w3, n_chars) as w3, sum(n) as {name} from (select {c}, w3, n, explode(filter(lengths, x -> x < length(w3))) as n_chars from «grown» join «lengths» using ({c})) group by 1, 2" + (", 3" if len(context) > 1 else ""),
        grown=grown,
        lengths=lengths,
    )
    return cut


def truncation_evidence(documents: DataFrame) -> DataFrame:
    """One row per document with text: what its last words tell, from the word trigrams of all texts.

    (doc_id, source, near_limit, in_lines, marked, ratio, goes_on, stops, ending): ``ratio`` is how much more often the final
    words go on than stop, against all words, the trigram's shares being smoothed by those of its last two and last;
    ``near_limit`` is 2 at the source's longest length, 1 within a twentieth of it, else 0; ``ending`` is one of ``open`` (an object without
    its closing brace), ``word`` (a word that occurs only longer in this place), ``whole`` (it ends on a closed object), ``stop``, ``line`` (a
    line that occurs as a whole line), ``next_line`` (a line always followed by another), ``comma``, ``bracket``
    (one left open), ``gram``,
    ``closer`` (a phrase that only ends texts) and ``unknown``. Trailing references in brackets and marks of
    omission are set aside first. Counts leave out deliveries of a text under
    another id, but not rows that repeat id and text.
    """
    spark = documents.sparkSession
    plain = spread(documents.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("text").cast("string")))
    docs = plain.withColumn("body", strip("text")).where("body != ''")
    bodies = docs.select("doc_id", "body")
    docs = _sql(
        spark,
        rf"""
        with a as (select *, if(right(body, 1) in (']', ')'), regexp_replace(body, '{_GROUPS}', ''), body) as shorn from «docs»),
        b as (select *, if(shorn = '', body, shorn) as core from a),
        c as (select *, if(locate(right(core, 1), '{_CLOSER_LIST}') > 0, regexp_replace(core, '{_CLOSED}', ''), core) as bare from b),
        d as (select *, case when right(bare, 3) = '...' or right(bare, 1) in ('…', '�') then 'mark' when right(bare, 1) in ('.', '!', '?', '。', '！', '？') then 'stop'
            when right(core, 1) in (',', ';', ':', '(', '—', '、') then 'comma' else '' end as tail from c),
        e as (select *, if(tail = 'mark' and regexp_replace(bare, '{_MARK}', '') != '', regexp_replace(bare, '{_MARK}', ''), core) as said from d),
        f as (select *, tail in ('mark', '') and right(said, 41) rlike '{_UNCLOSED}' as unclosed, {_plain("said")} as plain from e),
        g as (select *, substring_index(plain, ' ', -{_TAIL}) as last_part from f),
        h as (select *, {_marked("last_part")} as marked_part from g),
        i as (select *, if(length(last_part) = length(plain) or size({_tokens("marked_part")}) >= {_TAIL} - 4, marked_part, {_marked("plain")}) as marked_end from h)
        select doc_id, source, md5(text) as text_key, char_length(text) as n_chars, octet_length(text) as n_bytes, body, tail, unclosed, right(core, 1) as last_char,
          contains(body, '{{"') as structured, right(body, 1) = '}}' or right(body, 1) = ']' and (left(body, 1) = '[' or right(rtrim(left(body, length(body) - 1)), 1) = '}}') as is_closed, (length(body) - length(replace(body, '\n', ''))) * 120 > length(body) as in_lines, length(body) - length(replace(body, '{{', '')) > length(body) - length(replace(body, '}}', '')) as is_open,
          {_tokens("marked_end")} as ending, {_tokens("element_at(split(marked_end, 'ⓝ'), -1)")} as last_line
        from i
        """,
        docs=docs,
    )
    finals = materialize(
        _sql(
            spark,
            """
            select doc_id, source, text_key, n_chars, n_bytes, tail, unclosed, last_char, structured, is_closed, is_open, in_lines,
              coalesce(translate(get(ending, size(ending) - 3), 'ⓢⓝ', ''), '^') as w1, coalesce(translate(get(ending, size(ending) - 2), 'ⓢⓝ', ''), '^') as w2,
              coalesce(translate(get(ending, size(ending) - 1), 'ⓢⓝ', ''), '') as w3,
              if(size(last_line) <= 8, translate(array_join(last_line, ' '), 'ⓢⓝ', ''), null) as line
            from «docs»
            """,
            docs=docs,
        )
    )
    # Texts are not moved to tell repeated deliveries: their digests are, and the few ids to leave out.
    first = _sql(spark, "select text_key, min(doc_id) as doc_id from «f» group by 1 having count(*) > 1", f=finals)
    repeats = _sql(spark, "select distinct f.doc_id from «f» f join «r» r on f.text_key = r.text_key where f.doc_id != r.doc_id", f=finals, r=first)
    kept = bodies.join(broadcast_checked(materialize(repeats), 1_000_000), "doc_id", "left_anti")
    texts = _sql(spark, f"select {_marked('plain')} as marked from (select {_plain('body')} as plain from «k»)", k=kept)
    texts = _sql(spark, f"select marked, {_tokens('marked')} as tokens from «texts»", texts=texts)
    texts = _sql(spark, "select marked, tokens, transform(tokens, t -> translate(t, 'ⓢⓝ', '')) as words from «texts»", texts=texts)
    everything = materialize(_counts(texts))
    counts = everything.where("w1 is not null")
    totals = _sql(spark, "select greatest(sum(stops), 1) / greatest(sum(goes_on), 1) as stop_rate from «c»", c=counts).first()
    grams = _sql(spark, "select distinct w1, w2, w3 from «f»", f=finals)
    pairs = _sql(spark, "select w2, w3, sum(goes_on) as goes_on2, sum(stops) as stops2, sum(line_ends) as line_ends2, sum(text_ends) as text_ends2 from «c» group by 1, 2", c=counts)
    words = _sql(spark, "select w3, sum(goes_on2) as goes_on1, sum(stops2) as stops1 from «p» group by 1", p=pairs)
    known = (
        grams.join(counts, ["w1", "w2", "w3"], "left")
        .join(pairs, ["w2", "w3"], "left")
        .join(words, "w3", "left")
        .join(_extensions(counts, grams, ["w1", "w2"], "longer"), ["w1", "w2", "w3"], "left")
        .join(_extensions(counts, _sql(spark, "select distinct w2, w3 from «g»", g=grams), ["w2"], "longer2"), ["w2", "w3"], "left")
        .fillna(0)
    )
    beginnings = _sql(spark, "select w3 as line, stops as whole_lines, goes_on as longer_lines from «e» where w1 is null", e=everything)
    lines = _sql(spark, "select distinct line from «f» where line is not null", f=finals).join(beginnings, "line")
    met = salted_join(finals, known, ["w1", "w2", "w3"], ["doc_id"])
    met = salted_join(met, lines, ["line"], ["doc_id"])
    limits = _sql(spark, "select source, max(n_chars) as most_chars, max(n_bytes) as most_bytes from «f» group by 1", f=finals)
    met = met.join(broadcast_checked(limits, 100_000), "source")
    return _sql(
        spark,
        f"""
        with a as (select *, case when n_chars > most_chars - 3 or n_bytes > most_bytes - 4 then 2 when n_chars >= 0.95 * most_chars or n_bytes >= 0.95 * most_bytes then 1 else 0 end as near_limit, goes_on + stops >= 3 as sure3,
            tail != 'stop' and longer >= 3 and longer > 9 * (goes_on + stops) and longer > text_ends as cut3, goes_on + stops + longer >= 3 as seen3,
            tail != 'stop' and longer2 >= 3 and longer2 > 9 * (goes_on2 + stops2) and longer2 > text_ends2 as cut2,
            (goes_on1 + 0.5) / (goes_on1 + stops1 + 1) as p1 from «met»),
        b as (select *, (goes_on + 5 * (goes_on2 + 5 * p1) / (goes_on2 + stops2 + 5)) / (goes_on + stops + 5) as p3, if(sure3, goes_on, goes_on2) as on_, if(sure3, stops, stops2) as off_, if(sure3, line_ends, line_ends2) as lines_, if(sure3, text_ends, text_ends2) as ends_ from a)
        select doc_id, source, near_limit, in_lines, tail = 'mark' as marked, least({_MOST_RATIO}, least(p3, 0.999999) / (1 - least(p3, 0.999999)) * {totals['stop_rate']!r}D) as ratio, on_ as goes_on, off_ as stops,
          case when structured and is_open then 'open' when structured and is_closed then 'whole' when tail = 'stop' and last_char != '.' then 'stop'
            when cut3 or (not seen3 and cut2) then 'word' when tail = 'stop' then 'point' when unclosed then 'bracket' when tail = 'comma' then 'comma'
            when lines_ >= 20 and lines_ > 0.8 * (on_ + off_) and ends_ < 0.02 * lines_ then 'next_line'
            when whole_lines >= 2 and longer_lines < 0.2 * whole_lines then 'line' when on_ + off_ >= 3 then 'gram' when text_ends >= 3 and tail != '' or text_ends >= 3 and goes_on1 + stops1 = 0 then 'closer' when goes_on1 + stops1 >= 10 then 'gram' else 'unknown' end as ending
        from b
        """,
        met=met,
    )


def truncated(documents: DataFrame) -> DataFrame:
    """``truncation_evidence`` with ``is_truncated``: whether the text lacks its end.

    A final trigram that often goes on inside texts but hardly ever stops speaks for a cut, by the ratio of the
    two shares; how much is needed depends on the source: words cut in the middle show how often each source
    cuts, at or near its longest length and elsewhere, in prose and in lines, and give the prior odds. Null, empty
    and blank texts are left out; texts that end on a stop or a closed object are whole. The result holds one row
    per document row.
    """
    spark = documents.sparkSession
    evidence = materialize(truncation_evidence(documents))
    # For each cut inside a word about 0.75 fall between words or inside a number.
    groups = _sql(
        spark,
        """select source, near_limit, in_lines, least(0.98, (0.75 * count_if(ending = 'word') + 0.02) / (count_if(ending in ('comma', 'bracket', 'next_line', 'line', 'gram', 'closer', 'unknown')) + 1)) as prior
           from «e» group by 1, 2, 3""",
        e=evidence,
    )
    return _sql(
        spark,
        """
        with a as (select *, prior / (1 - prior) * if(marked, 100, 1) as odds from «j»)
        select doc_id, nullif(source, '') as source, near_limit, ending, goes_on, stops,
          case ending when 'open' then true when 'word' then true when 'comma' then odds * greatest(ratio, 1) * 200 > 1 when 'bracket' then odds * 500 > 1 when 'next_line' then odds * 50 > 1 when 'gram' then odds * ratio > 1
            when 'unknown' then odds * 3 > 1 when 'point' then odds > 1 and goes_on >= 5 and stops < 0.02 * (goes_on + stops) else false end as is_truncated
        from a
        """,
        j=evidence.join(broadcast_checked(groups, 100_000), ["source", "near_limit", "in_lines"]),
    )


def truncation_report(judged: DataFrame) -> DataFrame:
    """(source, texts, truncated_texts, share) per source of the rows ``truncated`` gives."""
    return _sql(judged, "select source, count(*) as texts, count_if(is_truncated) as truncated_texts, count_if(is_truncated) / count(*) as share from «t» group by 1", t=judged)
