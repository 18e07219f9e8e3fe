"""Values cut off by field limits or in transfer.

1. Prefix self-join. Every value publishes a hash of its prefixes at the steps of a ladder of fixed lengths,
   with the characters that follow. Every value, however it ends, looks itself up at its last step: it is a
   strict prefix of a longer copy if the hash and the rest agree. No texts are joined, and no step brings all
   texts that share it together with all values that do: a step is first joined with the one row that says
   which lengths are asked for there, then what it shows is cut at just these lengths and joined on the whole
   value. Steps that many texts share (the short ones, or a template's) meet single rows only, so such a join
   can be split anywhere.
2. Limits. Lengths (in characters or bytes) at which such prefixes pile up within a source are its field
   limits; unfinished values of just that length are cut too, with or without a copy.
3. Endings. How often each pair of last words ends a value against how often it goes on, counted over all
   values: an ending that nearly always goes on elsewhere is a cut, and so is a last word that stands nowhere else. Marks of a broken character or an
   ellipsis at the end are cuts as well.

A longer copy tells by itself whether it goes on with a new sentence, or with just the final mark (`between`); limits and
endings judge only values that don't end with a sentence (`finished`).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from factloom.llm import sentences
from factloom.llm.common import materialize

#: Steps of the ladder of prefix lengths: some short ones, then every STEP characters. What follows is published up to the next step and BEYOND it.
FIRST_STEPS, STEP, BEYOND = (0, 8, 16), 32, 16
#: Characters at a value's end that tell whether it is finished; more are looked at where closing markup or an open quotation is longer.
ENDING, TAIL = 160, 120
#: A length is a limit of a source's field if at least LIMIT_ROWS different cut values have it, and twice as many, and SIGMAS
#: deviations, as the lengths up to NEAR from it have on average (of which none counts for more than the length itself).
LIMIT_ROWS, NEAR, SIGMAS = 3, 32, 8
#: An ending is a cut if it ends a value in less than ENDS of its occurrences, of which there are at least SEEN.
ENDS, SEEN = 0.12, 5
#: A value of just a limit's length is whole if so many times as many unfinished values of other lengths end like it.
USUAL = 4
#: Counts that a worker keeps before it gives them out.
COUNTERS = 1 << 19
#: Rungs of the ladder that a worker remembers having given out.
RUNGS = 1 << 18

ENDED = regex.compile(rf"({sentences.MARK}+)((?:{sentences.CLOSERS}|\s)*{sentences.CITATION}*)\s*$")
ABBREVIATIONS = frozenset(" ".join(sentences.NEVER_LAST.values()).split()) | {"a.m", "p.m", "E.g", "I.e"}
#: Words before a point that may be within a sentence as well as at its end.
PERHAPS = frozenset(" ".join(sentences.PERHAPS_LAST.values()).split())
#: A number, perhaps in a bracket or at the end of a range, whose point may be a decimal one.
BEFORE_POINT = regex.compile(r"(?:^|[^\p{N}.])\p{N}+$")
#: Second parts of spaced abbreviations, with what stands before them.
SPACED = {"ex": "p.", "ej": "p.", "UU": "EE."}
CLOSING = regex.compile(r"(?:\s|(?<=[\p{P}\s])\}|\}$|</\w+>|\\label\{[^{}]*\})+$")
TOKEN = regex.compile(r"\p{N}+(?:[.,]\p{N}+)*|[\p{Han}\p{Hiragana}\p{Katakana}]|[\p{L}\p{M}]+(?:[-+’'][\p{L}\p{M}\p{N}]*)*|\S")
FINAL_MARKS = frozenset(".!?。！？।؟")
QUOTES = (("“", "”"), ("«", "»"), ("„", "“”"), ("「", "」"))


def squeezed(text: str) -> str:
    return " ".join(text.split())


def quote_open_at(text: str) -> int:
    """Where a quotation starts that is open at the end, the first of them; -1 if there is none."""
    found = []
    for a, b in QUOTES:
        at = text.rfind(a)
        if at >= 0 and not any(c in text[at + 1 :] for c in b) and not (a == "“" and "„" in text[:at]):
            found.append(at)
    return min(found, default=-1)


def open_quote(text: str) -> bool:
    """A quotation is open at the end."""
    return quote_open_at(text) >= 0


def without_closing(text: str) -> str:
    """Without closing markup at the end."""
    if not (text[-1:] in ("}", ">") or text[-1:].isspace()):
        return text
    n = ENDING
    while True:
        m = CLOSING.search(text[-n:])
        if m is None or m.start() > 0 or n >= len(text):
            return text[:-n] + text[-n:][: m.start() if m else None]
        n *= 4


def tail_of(text: str) -> str:
    """The end of a text: TAIL characters, or from where an open quotation starts."""
    at = quote_open_at(text)
    return text[-TAIL:] if at < 0 else text[min(at, max(0, len(text) - TAIL)) :]


def last_step(n: int) -> int:
    """The last step of the ladder that a text of n characters reaches."""
    return n // STEP * STEP if n >= STEP else max(x for x in FIRST_STEPS if x <= n)


def steps(n: int) -> Iterator[tuple[int, int]]:
    """(step, next step) of the ladder below n."""
    step, rising = 0, iter((*FIRST_STEPS[1:], STEP))
    while step < n:
        following = next(rising, step + STEP)
        yield step, following
        step = following


def abbreviated(head: str) -> bool:
    """Whether the point at the end of head belongs to an abbreviation or an initial."""
    before, _, word = head[-40:-1].rpartition(" ")
    word = word.lstrip("([{\"'“«„‘—–’")
    return word in ABBREVIATIONS or len(word) == 1 and word.isalpha() or word in SPACED and before.endswith(SPACED[word]) or word.rpartition("’")[2] in ABBREVIATIONS


def finished(text: str) -> int:
    """2: ends with a sentence. 1: ends with a mark that may be within one (a number's, 'et al.', a spaced one). 0: neither. Closing markup doesn't count."""
    head = without_closing(text)[-ENDING:]
    if head[-1:] not in FINAL_MARKS:
        m = ENDED.search(head)
        if m is None or open_quote(text):
            return 0
        if m[2].strip():
            return 2
        head = head[: m.end(1)]
    elif open_quote(text):
        return 0
    if head.endswith(("…", "..")):
        return 0
    if head[-1] == ".":
        if abbreviated(head):
            return 0
        number = head[:-1].rpartition(" ")[2]
        if number in PERHAPS or not number or BEFORE_POINT.search(number) and not any(map(str.isalpha, number)):
            return 1
    return 2


def between(tail: str, after: str) -> bool:
    """Whether a longer copy goes on with a new sentence, or with just the final mark, after a value that ends with tail."""
    if regex.match(rf"\s*{sentences.MARK}+(?:{sentences.CLOSERS})*(?:\s|$)", after) and tail[-1:].isalnum():
        return regex.match(r"\.\p{N}", after) is None
    whole = tail + after
    return any(b == len(tail.rstrip()) for _, b in sentences.spans(whole)[:-1])


def masked(token: str) -> str:
    """Names, which have a capital or a digit, and numbers are alike."""
    if token[0].isdigit():
        return "0.0" if any(c in token for c in ".,") else "0"
    if len(token) > 1 and any(c.isupper() or c.isdigit() for c in token):
        return "N"
    return token


_masks: dict[str, tuple[str, ...]] = {}


def _masked_parts(word: str) -> tuple[str, ...]:
    parts = tuple(map(masked, TOKEN.findall(word)))
    if len(word) <= 40:
        if len(_masks) >= 1 << 18:
            _masks.clear()
        _masks[word] = parts
    return parts


def grams(text: str) -> list[str]:
    """The masked tokens of a text."""
    get = _masks.get
    return [m for w in text.split() for m in get(w) or _masked_parts(w)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _hash(text: str) -> int:
    return _signed(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")))


def _halves(value: int) -> tuple[int, int]:
    """A 128-bit hash as two columns: 64 bits would make texts meet by chance in a corpus of 10^11."""
    return _signed(value >> 64), _signed(value & 0xFFFFFFFFFFFFFFFF)


VALUE_SCHEMA = "row_id bigint, source string, field string, chars int, bytes int, broken boolean, ended int, prefix bigint, check bigint, rest string, tail string, two bigint, one bigint, word boolean, number boolean"


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is known of each value. The last words count only where it doesn't end like a finished one."""
    for batch in batches:
        rows = []
        for row_id, source, field, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            text = squeezed(raw)
            ended = finished(text)
            broken = text.endswith(("�", "…")) or text.endswith("...")
            step = last_step(len(text))
            prefix, check = _halves(xxhash.xxh3_128_intdigest((field + text[:step]).encode("utf-8", "surrogatepass")))
            if ended == 2:
                last, two, one = "", 0, 0  # only a longer copy can tell that it is cut
            else:
                shown = without_closing(text)[-200:]
                tokens = grams(shown.lower() if shown.isupper() else shown)
                last = tokens[-1] if tokens else ""
                two, one = _hash("\x1f".join(tokens[-2:])), _hash(last)
            rows.append((row_id, source, field, len(raw), len(raw.encode("utf-8", "surrogatepass")), broken, ended, prefix, check, text[step:], tail_of(text), two, one, last[:1].isalpha() and last != "N", last[:1].isdigit()))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 15
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
        names = [x.split()[0] for x in VALUE_SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _ladder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A hash of the prefix at each step, with what follows; most copies that one worker sees are given out once."""
    given: set[tuple[int, str]] = set()
    for batch in batches:
        new: list[tuple[int, str]] = []
        for field, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = squeezed(raw)
            state = xxhash.xxh3_128(field.encode())
            for step, following in steps(len(text)):
                rung = (state.intdigest(), text[step : following + BEYOND])
                if rung not in given:
                    given.add(rung)
                    new.append(rung)
                state.update(text[step:following].encode("utf-8", "surrogatepass"))
            if len(given) > RUNGS:
                given.clear()
        halves = np.array([(h >> 64, h & 0xFFFFFFFFFFFFFFFF) for h, _ in new], np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array([x for _, x in new], pa.string())], names=["prefix", "check", "shown"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often every pair of neighbouring words, and every word, ends a value (a final mark may follow) or goes on.

    Summed up within the partition; the sums are given out whenever there are COUNTERS of them, so memory stays bounded.
    """
    ends: Counter = Counter()
    goes: Counter = Counter()

    def given_out() -> pa.RecordBatch:
        keys = list({*ends, *goes})
        hashes = [_hash(k if isinstance(k, str) else "\x1f".join(k)) for k in keys]
        out = [pa.array(hashes, pa.int64()), pa.array([ends[k] for k in keys], pa.int64()), pa.array([goes[k] for k in keys], pa.int64())]
        ends.clear()
        goes.clear()
        return pa.RecordBatch.from_arrays(out, names=["gram", "ends", "goes"])

    for batch in batches:
        for raw in batch.column(0).to_pylist():
            tokens = grams(without_closing(raw))
            n = len(tokens)
            if not n:
                continue
            last = 2 if n > 1 and tokens[-1] in FINAL_MARKS else 1
            for k in range(last):
                ends[tokens[n - k - 1]] += 1
                if n - k > 1:
                    ends[tokens[n - k - 2], tokens[n - k - 1]] += 1
            inner = tokens[: n - last]
            goes.update(inner)
            goes.update(zip(inner, inner[1:], strict=False))
        if len(goes) + len(ends) > COUNTERS:
            yield given_out()
    yield given_out()


def _judge(frames):
    for f in frames:
        yield f.loc[[not between(t, a) for t, a in zip(f["tail"], f["after"], strict=True)], ["prefix", "check", "rest"]]


VALUE = ["prefix", "check", "rest"]


def longer_copies(values: DataFrame, ladder: DataFrame) -> DataFrame:
    """(prefix, check, rest): the distinct values that are strict prefixes of a longer copy which goes on within the sentence.

    A step that many texts share is joined with one row, the bits of the lengths that values ask for there; an extension
    is joined with one row too, the value it extends. Both joins are on keys that are unique on one side, so adaptive
    execution can split the other side of a hot one; their work is in proportion to the texts.
    """
    asked = values.groupBy("prefix", "check").agg(F.bit_or(F.expr("shiftleft(1L, length(rest))")).alias("asked"))
    at = F.filter(F.sequence(F.lit(0), F.lit(STEP - 1)), lambda k: (F.getbit("asked", k) == 1) & (F.length("shown") > k))
    met = ladder.join(asked, ["prefix", "check"]).select("prefix", "check", "shown", F.explode(at).alias("k"))
    extended = met.select("prefix", "check", F.expr("substr(shown, 1, k)").alias("rest"), F.expr("substr(shown, k + 1)").alias("after"))
    once = values.groupBy(*VALUE).agg(F.max("tail").alias("tail"))
    return once.join(extended, VALUE).select(*VALUE, "tail", "after").mapInPandas(_judge, "prefix bigint, check bigint, rest string").distinct()


def detect(records: DataFrame, fields: tuple[str, ...] = ("caption", "context"), key: str = "row_id", source: str = "source") -> DataFrame:
    """(row_id, field, source, why): every value cut off before its end, within a word or a sentence.

    why: 'prefix' (a longer copy goes on), 'limit' (just as long as its source's limit), 'broken' (a broken character or an
    ellipsis at the end) or 'ending' (such an ending goes on nearly everywhere else).

    Null, empty and blank values are no cases, a null source is a source of its own. Each row is judged for itself, also
    where rows are repeated; a value equal to another is no prefix of it. An empty table gives no rows.
    """
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), records[f].alias("text")) for f in fields]))
    texts = records.select(records[key].cast("bigint").alias("row_id"), F.coalesce(records[source], F.lit("")).alias("source"), each.alias("x")).select("row_id", "source", "x.field", "x.text").where("text is not null and trim(text) <> ''")
    values = materialize(texts.mapInArrow(_values, VALUE_SCHEMA))
    ladder = texts.select("field", "text").mapInArrow(_ladder, "prefix bigint, check bigint, shown string")
    cut = materialize(longer_copies(values.select(*VALUE, "tail"), ladder))
    prefixed = materialize(values.join(cut, VALUE).select("row_id", "field", "source", "chars", "bytes", *VALUE))
    marked = prefixed.select("row_id", "field", F.lit("prefix").alias("why")).distinct()
    known = values.where("ended < 2").join(marked, ["row_id", "field"], "left")
    # limits: lengths at which prefixes pile up
    lengths = prefixed.select("source", "field", *VALUE, "chars", "bytes").distinct().groupBy("source", "field", "chars", "bytes").agg(F.count("*").alias("n"))
    # a value counts in the unit whose pile is higher: a limit in characters piles up at several lengths in bytes too
    units = lengths.withColumn("c", F.sum("n").over(Window.partitionBy("source", "field", "chars"))).withColumn("b", F.sum("n").over(Window.partitionBy("source", "field", "bytes")))
    unit = F.explode(F.array(F.when(F.col("c") >= F.col("b"), F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size"))), F.when(F.col("b") >= F.col("c"), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size")))))
    piled = units.select("source", "field", "n", unit.alias("x")).where("x is not null").groupBy("source", "field", "x.unit", "x.size").agg(F.sum("n").alias("n"))
    around = F.collect_list("n").over(Window.partitionBy("source", "field", "unit").orderBy("size").rangeBetween(-NEAR, NEAR))
    limits = piled.withColumn("around", around).withColumn("usual", (F.aggregate("around", F.lit(0).cast("bigint"), lambda s, x: s + F.least(x, F.col("n"))) - F.col("n")) / (2 * NEAR))
    limits = limits.where((F.col("n") >= LIMIT_ROWS) & (F.col("n") >= 2 * F.col("usual") + SIGMAS * F.sqrt("usual")))
    of = limits.groupBy("source", "field").agg(F.collect_list(F.when(F.col("unit") == "chars", F.col("size"))).alias("in_chars"), F.collect_list(F.when(F.col("unit") == "bytes", F.col("size"))).alias("in_bytes"))
    at = F.coalesce(F.array_contains("in_chars", F.col("chars")), F.lit(False)) | F.coalesce(F.exists("in_bytes", lambda b: (F.col("bytes") == b) | (F.col("bytes") < b) & (F.col("bytes") > b - 4) & (F.col("bytes") > F.col("chars"))), F.lit(False))
    known = known.join(of, ["source", "field"], "left").withColumn("at_limit", at)
    of_ending = known.groupBy("two").agg(F.count_if("at_limit").alias("on_limit"), F.count_if(~F.col("at_limit")).alias("off_limit"))
    known = known.join(of_ending, "two")
    # endings
    counts = texts.select("text").mapInArrow(_counts, "gram bigint, ends bigint, goes bigint").groupBy("gram").agg(F.sum("ends").alias("ends"), F.sum("goes").alias("goes"))
    two = counts.select(F.col("gram").alias("two"), F.col("ends").alias("ends2"), F.col("goes").alias("goes2"))
    one = counts.select(F.col("gram").alias("one"), F.col("ends").alias("ends1"), F.col("goes").alias("goes1"))
    known = known.join(two, "two", "left").join(one, "one", "left")
    all2, all1 = F.col("ends2") + F.col("goes2"), F.col("ends1") + F.col("goes1")
    goes_on = F.when(all2 >= SEEN, F.col("ends2") < ENDS * all2).when(F.col("number"), False).when(all1 >= SEEN, F.col("ends1") < ENDS * all1).otherwise(F.col("word") & (F.coalesce("goes1", F.lit(0)) == 0))
    usual = (F.col("off_limit") >= SEEN) & (F.col("off_limit") >= USUAL * F.col("on_limit"))
    why = F.coalesce("why", F.when(F.col("broken"), "broken"), F.when(F.col("at_limit") & ~usual, "limit"), F.when((F.col("ended") == 0) & F.coalesce(goes_on, F.lit(False)), "ending"))
    ended = values.where("ended = 2").select("row_id", "field", "source").join(marked, ["row_id", "field"])
    return known.select("row_id", "field", "source", why.alias("why")).where("why is not null").unionByName(ended)


def rates(found: DataFrame, records: DataFrame, fields: tuple[str, ...] = ("caption", "context"), source: str = "source") -> DataFrame:
    """Share of cut values among the values of each source and field that aren't null or blank."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.trim(records[f]) != "", F.lit(False)).alias("there")) for f in fields]))
    all_values = records.select(F.coalesce(records[source], F.lit("")).alias("source"), each.alias("x")).where("x.there").groupBy("source", F.col("x.field").alias("field")).agg(F.count("*").alias("n_values"))
    cut = found.groupBy("source", "field").agg(F.count("*").alias("n_cut"))
    n = F.coalesce("n_cut", F.lit(0))
    return all_values.join(cut, ["source", "field"], "left").select("source", "field", "n_values", n.alias("n_cut"), (n / F.col("n_values")).alias("rate"))
