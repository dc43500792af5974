"""The decision language: text to a struct, with a count of errors.

All of it is native expressions. Clean text is read by one anchored pattern. Any other text is cut into tokens, which are reduced to
a string with a letter for each; one pattern over these letters is the whole grammar, the skip to the next block after an error
included, and the tokens that its groups stand over give the values. White space between tokens is optional and is what Unicode calls
so; a candle's number may have any decimal digits, the digits of prices are ASCII.
"""

from __future__ import annotations

import re
import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewright.schema import ACTIONS, BIN_MAX, CANDLE, DIGITS, INPUT_CANDLES, PROGRAM, STRUCTURAL_PENALTY, VALUE_PENALTY

# A letter for each kind of token, and its pattern, in the order in which they are tried.
TOKENS = [
    ("[", r"<chart>"),
    ("]", r"</chart>"),
    ("O", r"<O_\d+>"),
    ("H", r"<H_\d+>"),
    ("L", r"<L_\d+>"),
    ("C", r"<C_\d+>"),
    ("{", r"<think>"),
    ("}", r"</think>"),
    ("T", r"<trend>(?:UP|DOWN|RANGE)</trend>"),
    ("p", r"<current_price>"),
    ("P", r"</current_price>"),
    ("s", r"<zone_support>"),
    ("S", r"</zone_support>"),
    ("r", r"<zone_resistance>"),
    ("R", r"</zone_resistance>"),
    ("z", r"<price_in_zone>"),
    ("g", r"<good_price_action>"),
    ("(", r"<action>"),
    (")", r"</action>"),
    ("A", r"\b(?:CANCEL_BUY|CANCEL_SELL|WAIT_BUY|WAIT_SELL|BUY|SELL|HOLD)\b"),
    ("l", r"SL:"),
    ("q", r"<RR_[1-9]>"),
    ("d", r"[0-9]"),
    (":", r":"),
]
_W = r"\s*"
_NUMBER = _W.join(["([0-9]", "[0-9]", "[0-9]", "[0-9])"])
_CANDLES = _W.join(r"<%s_[0-9]+>" % k for k in "OHLC")
CLEAN = (
    rf"^\s*<chart>\s*((?:{_CANDLES}\s*){{{INPUT_CANDLES}}})</chart>\s*<think>\s*<trend>(UP|DOWN|RANGE)</trend>\s*<current_price>\s*{_NUMBER}\s*</current_price>"
    rf"\s*(?:<zone_(support|resistance)>\s*{_NUMBER}\s*:\s*{_NUMBER}\s*</zone_\4>)?\s*(<price_in_zone>)?\s*(<good_price_action>)?\s*</think>"
    rf"\s*<action>\s*\b({'|'.join(sorted(ACTIONS, key=len, reverse=True))})\b\s*(?:SL:\s*{_NUMBER})?\s*(?:<RR_([1-9])>)?\s*</action>\s*$"
)


def parse_clean(frame: DataFrame, text: str = "text") -> DataFrame:
    """PROGRAM's columns by native expressions, for texts of clean shape; ``clean`` tells where they hold (no error at all)."""
    t = F.coalesce(F.col(text), F.lit(""))
    # one run of the pattern gives all groups; another text keeps its own shape, with another number of parts
    parts = F.split(F.regexp_replace(t, CLEAN, "|".join(["", *(f"${n}" for n in range(1, 12)), ""])), r"\|", -1)
    frame = frame.withColumn("__g", parts)

    def group(n: int) -> Column:
        return F.when(F.size("__g") == 13, F.nullif(F.element_at("__g", n + 1), F.lit("")))

    def number(n: int) -> Column:
        return F.regexp_replace(group(n), r"\s+", "").cast("int")

    bins = [F.regexp_extract_all(group(1), F.lit(f"<{p}_([0-9]+)>"), F.lit(1)) for p in "OHLC"]
    candles = F.transform(F.arrays_zip(*[b.alias(k) for b, k in zip(bins, "ohlc", strict=True)]), lambda x: F.struct(*[x[k].try_cast("int").alias(k) for k in "ohlc"])).cast(f"array<{CANDLE}>")
    out = frame.withColumns(
        {
            "candles": candles, "trend": group(2), "current_price_bin": number(3), "zone_direction": group(4), "zone_lower": number(5), "zone_upper": number(6),
            "price_in_zone": group(7).isNotNull(), "good_price_action": group(8).isNotNull(), "action_type": group(9), "sl": number(10), "rr": group(11).cast("int"),
        }
    )
    trade = F.col("action_type").isin("BUY", "SELL")
    in_range = lambda c: c.isNull() | (c <= BIN_MAX)
    clean = (
        F.col("action_type").isNotNull()
        & F.forall("candles", lambda c: F.least(*[c[k].isNotNull().cast("int") for k in "ohlc"]).cast("boolean") & (F.greatest(*[c[k] for k in "ohlc"]) <= BIN_MAX))
        & in_range(F.col("current_price_bin")) & in_range(F.col("zone_lower")) & in_range(F.col("zone_upper")) & in_range(F.col("sl"))
        & (F.element_at("candles", -1)["c"] == F.col("current_price_bin"))
        & (F.col("sl").isNotNull() == trade) & (F.col("rr").isNotNull() == trade) & (F.col("good_price_action") == trade)
    )
    return out.withColumns({"n_structural": F.lit(0), "n_value": F.lit(0), "clean": F.coalesce(clean, F.lit(False))}).drop("__g")


#: A token as TOKENS has them, tried in that order; what begins none runs on to a blank or "<".
_WORD = r"[\p{L}\p{N}_]"
LEX = "(?U)" + "|".join(p.replace(r"\b", rf"(?<!{_WORD})", 1).replace(r"\b", rf"(?!{_WORD})") for _, p in TOKENS) + r"|[^\s\x1c-\x1f][^ \t\n<]*"
_UNKNOWN = "?"
#: The letter of each token that has one text, or few.
_LETTERS = {
    **{p: k for k, p in TOKENS if re.fullmatch(r"[</>a-z_:SL]+", p)},
    **{f"<trend>{t}</trend>": "T" for t in ("UP", "DOWN", "RANGE")}, **dict.fromkeys(ACTIONS, "A"), **{f"<RR_{n}>": "q" for n in range(1, 10)}, **dict.fromkeys("0123456789", "d"),
}


def text_tokens(text: Column) -> Column:
    """The texts of the tokens, in order."""
    # an action's name right behind a digit is none; a mark between them makes its text another
    marked = F.regexp_replace(text, "(?<=[0-9])(?=CANCEL_|WAIT_|BUY|SELL|HOLD)", "\x01")
    return F.regexp_extract_all(marked, F.lit(LEX), F.lit(0))


def token_letters(tokens: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in _LETTERS.items() for x in pair])
    letter = lambda t: F.coalesce(F.try_element_at(known, t), F.when(t.rlike(r"(?U)^<[OHLC]_\d+>$"), F.substring(t, 2, 1)), F.lit(_UNKNOWN))
    return F.array_join(F.transform(tokens, letter), "")


_SKIP = r"[^\]{}()$]*+"
#: The grammar over letters, closed by "$": each block is read as far as it goes, then skipped to the next token that opens or closes one.
GRAMMAR = (
    rf"^(?<A>(?<chart>\[)(?<run>(?:OH?L?C?)*+)(?:(?<charted>\])|{_SKIP})|{_SKIP})"
    rf"(?<B>(?<think>\{{)(?<trend>T)?+(?:(?<price>p)(?<pd>d*+)(?<priced>P)?+)?+"
    r"(?:(?<s>s)(?<sa>d*+)(?<sm>:)?+(?<sb>d*+)(?<se>S)?+|(?<r>r)(?<ra>d*+)(?<rm>:)?+(?<rb>d*+)(?<re>R)?+)?+"
    rf"(?<inside>z)?+(?<good>g)?+(?:(?<thought>\}})|{_SKIP})|{_SKIP})"
    rf"(?<C>(?<act>\()(?<action>A)?+(?:(?<stop>l)(?<ld>d*+))?+(?<rr>q)?+(?:(?<acted>\))|{_SKIP})|{_SKIP})(?<rest>.*)$"
)
_GROUPS = re.findall(r"\?<(\w+)>", GRAMMAR)
#: Every decimal digit beyond ASCII, and what it stands for.
_WIDE = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
_FROM, _TO = "".join(_WIDE), "".join(str(unicodedata.decimal(c)) for c in _WIDE)


def _beyond(digits: Column) -> Column:
    """Is the number no bin?"""
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.when(F.length(short) > 4, True).otherwise(short.cast("int") > BIN_MAX)


def _settled(frame: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """withColumns for columns that are costly and much used: each is worked out once a row, as filters and projections above don't reach through a generator."""
    return frame.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def parse_any(frame: DataFrame, text: str) -> DataFrame:
    """The frame with __read: PROGRAM's fields, n_structural and n_value of any text; null where the text is null."""
    frame = _settled(frame, {"__t": text_tokens(F.col(text))})
    letters = F.concat(token_letters(F.col("__t")), F.lit("$"))
    frame = _settled(frame, {"__p": F.split(F.regexp_replace(letters, GRAMMAR, "|".join(f"${{{g}}}" for g in _GROUPS)), r"\|", -1)})

    def group(name: str) -> Column:
        return F.element_at("__p", _GROUPS.index(name) + 1)

    def has(*names: str) -> Column:
        return F.concat(*map(group, names)) != ""

    def size(*names: str) -> Column:
        return F.length(F.concat(*map(group, names)))

    def lacks(*names: str) -> Column:
        return (~has(*names)).cast("int")

    def tokens(start: Column, n: Column) -> Column:
        return F.slice("__t", start, n)

    def number(start: Column, *names: str) -> tuple[Column, Column]:
        """A run of digit tokens as a bin (null if it is none), and its value errors."""
        digits = F.array_join(tokens(start, size(*names)), "")
        given, off = digits != "", F.coalesce(_beyond(F.nullif(digits, F.lit(""))), F.lit(False))
        return F.when(given & ~off, digits.cast("int")), (F.length(digits) != DIGITS).cast("int") + off.cast("int")

    one = F.lit(1)
    joined = F.array_join(tokens(one * 2, size("run")), " ")
    frame = _settled(frame, {"__c": F.when(joined.rlike(r"[^\x00-\x7F]"), F.translate(joined, _FROM, _TO)).otherwise(joined)})
    whole = r"<O_(\d+)> <H_(\d+)> <L_(\d+)> <C_(\d+)>"
    bins = [F.regexp_extract_all("__c", F.lit(whole), F.lit(k)).alias(n) for k, n in enumerate("ohlc", 1)]
    good = F.filter(F.arrays_zip(*bins), lambda x: ~(_beyond(x["o"]) | _beyond(x["h"]) | _beyond(x["l"]) | _beyond(x["c"])))
    candles = F.transform(good, lambda x: F.struct(*[x[k].cast("int").alias(k) for k in "ohlc"])).cast(f"array<{CANDLE}>")
    frame = _settled(frame, {"__candles": F.when(has("chart"), candles)})
    over = F.size(F.filter(F.regexp_extract_all("__c", F.lit(r"_(\d+)>"), F.lit(1)), _beyond))
    opened = F.size(F.regexp_extract_all(group("run"), F.lit("O"), F.lit(0)))

    base = size("A") + 1  # the token that opens the thoughts
    at_price = base + 1 + size("trend")
    price, price_errors = number(at_price + 1, "pd")
    at_zone = at_price + size("price", "pd", "priced")
    low, low_errors = number(at_zone + 1, "sa", "ra")
    high, high_errors = number(at_zone + 1 + size("sa", "ra", "sm", "rm"), "sb", "rb")
    zone = has("s", "r")
    at_action = size("A", "B") + 2
    stop, stop_errors = number(at_action + size("action") + 1, "ld")
    named = lambda start: F.try_element_at("__t", start)
    fields = {
        "__price": F.when(has("price"), price), "__low": F.when(zone, low), "__high": F.when(zone, high), "__stop": F.when(has("stop"), stop),
        "__action": F.when(has("action"), named(at_action)), "__rr": F.when(has("rr"), F.substring(named(at_action + size("action", "stop", "ld")), 5, 1).cast("int")),
        "__value": F.when(has("chart"), over + (F.size("__candles") != INPUT_CANDLES).cast("int")).otherwise(0)
        + F.when(has("think"), F.when(has("price"), price_errors).otherwise(1) + F.when(zone, low_errors + high_errors).otherwise(0)).otherwise(0)
        + F.when(has("stop"), stop_errors).otherwise(0),
        "__structural": F.when(has("chart"), 4 * opened - size("run") + lacks("charted")).otherwise(1)
        + F.when(has("think"), lacks("trend") + F.when(has("price"), lacks("priced")).otherwise(0) + F.when(zone, lacks("sm", "rm") + lacks("se", "re")).otherwise(0) + lacks("thought")).otherwise(1)
        + F.when(has("act"), lacks("action") + lacks("acted")).otherwise(1) + (group("rest") != "$").cast("int"),
    }
    frame = _settled(frame, fields)
    trade = F.col("__action").isin("BUY", "SELL")
    told = sum(((g != trade).cast("int") for g in (F.col("__stop").isNotNull(), F.col("__rr").isNotNull(), has("good"))), F.lit(0))
    both = F.col("__low").isNotNull() & F.col("__high").isNotNull()
    last = F.try_element_at("__candles", F.lit(-1))["c"]
    read = F.struct(
        F.col("__candles").alias("candles"), F.when(has("trend"), F.regexp_replace(named(base + 1), "^<trend>|</trend>$", "")).alias("trend"), F.col("__price").alias("current_price_bin"),
        F.when(both, F.when(has("s"), "support").otherwise("resistance")).alias("zone_direction"), F.when(both, F.col("__low")).alias("zone_lower"), F.when(both, F.col("__high")).alias("zone_upper"),
        F.when(has("think"), has("inside")).alias("price_in_zone"), F.when(has("think"), has("good")).alias("good_price_action"), F.col("__action").alias("action_type"),
        F.col("__stop").alias("sl"), F.col("__rr").alias("rr"),
        (F.col("__structural") + F.when(has("think") & F.col("__action").isNotNull(), told).otherwise(0)).alias("n_structural"),
        (F.col("__value") + F.coalesce((last != F.col("__price")).cast("int"), F.lit(0))).alias("n_value"),
    )
    return _settled(frame, {"__read": F.when(F.col(text).isNotNull(), read)}).drop("__t", "__p", "__c", "__candles", *fields)


def parse_programs(frame: DataFrame, text: str = "text") -> DataFrame:
    """PROGRAM's columns for every row: clean texts as the anchored pattern read them, the others token by token; with well_formed and wf_score."""
    read = parse_clean(frame, text)
    names = [c for c in read.columns[len(frame.columns) :] if c != "clean"]
    read = _settled(read, {"__clean": F.struct(*names)})
    read = parse_any(read.withColumn("__other", F.when(~F.col("clean"), F.coalesce(F.col(text), F.lit("")))), "__other")
    out = _settled(read.drop(*names), {c: F.when(F.col("clean"), F.col(f"__clean.{c}")).otherwise(F.col(f"__read.{c}")) for c in names}).drop("clean", "__clean", "__other", "__read")
    score = F.greatest(F.lit(0.0), 1 - (STRUCTURAL_PENALTY * F.col("n_structural") + VALUE_PENALTY * F.col("n_value")))
    return out.withColumns({"well_formed": (F.col("n_structural") + F.col("n_value")) == 0, "wf_score": score})


def intended_action(completion: Column) -> Column:
    """The first action word anywhere in a completion, well-formed or not."""
    return F.nullif(F.regexp_extract(completion, rf"(?U)\b({'|'.join(sorted(ACTIONS, key=len, reverse=True))})\b", 1), F.lit(""))


def assembled(prompt: Column, completion: Column) -> Column:
    return F.concat_ws(" ", prompt, completion)


def token_kinds(frame: DataFrame, text: str = "text") -> DataFrame:
    """kinds: a letter of TOKENS for each token of the text, ``?`` for a stretch that is none; null counts as empty."""
    return frame.withColumn("kinds", token_letters(text_tokens(F.coalesce(F.col(text), F.lit("")))))


def kind_counts(frame: DataFrame, text: str, *by: str) -> DataFrame:
    """by, kind, n: how many tokens of each kind the texts hold."""
    letters = token_kinds(frame, text).select(*by, F.explode(F.split("kinds", "")).alias("kind")).where("kind <> ''")
    return letters.groupBy(*by, "kind").agg(F.count("*").alias("n"))
