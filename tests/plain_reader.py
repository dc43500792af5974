"""A plain reader of the decision language, text by text, to hold the library's against."""

from __future__ import annotations

import re

from candlewright.operators.language import TOKENS
from candlewright.schema import BIN_MAX, DIGITS, INPUT_CANDLES, PROGRAM

UNKNOWN, END = "?", "$"
_MASTER = re.compile("|".join(f"({p})" for _, p in TOKENS) + r"|(\s+)|(.)", re.S)
_SPACE = len(TOKENS) + 1
_LETTERS = [k for k, _ in TOKENS]
_RESUME = re.compile(r"[]{}()$]")


def lex(text: str) -> tuple[str, list[str], list[int]]:
    """A letter, the text and the place of each token; stretches without one are UNKNOWN up to a blank or '<'."""
    kinds, values, places = [], [], []
    at = 0
    while at < len(text):
        m = _MASTER.match(text, at)
        group = m.lastindex
        if group == _SPACE:
            at = m.end()
            continue
        if group > _SPACE:
            end = at + 1
            while end < len(text) and text[end] not in " \t\n<":
                end += 1
            kinds.append(UNKNOWN)
        else:
            end = m.end()
            kinds.append(_LETTERS[group - 1])
        values.append(text[at:end])
        places.append(at)
        at = end
    return "".join(kinds) + END, [*values, ""], [*places, len(text)]


class _Reading:
    """One text's tokens with a place, and the errors met."""

    def __init__(self, text: str):
        self.kinds, self.values, _ = lex(text)
        self.at, self.structural, self.value = 0, 0, 0

    def meet(self, kind: str) -> str | None:
        """The next token's text, if it is of the kind."""
        if self.kinds[self.at] != kind:
            return None
        self.at += kind != END
        return self.values[self.at - 1] if kind != END else ""

    def must(self, kind: str, value_error: bool = False) -> str | None:
        got = self.meet(kind)
        if got is None:
            self.structural += not value_error
            self.value += value_error
        return got

    def resume(self) -> None:
        self.at = _RESUME.search(self.kinds, self.at).start()

    def close(self, kind: str) -> None:
        if self.must(kind) is None:
            self.resume()

    def number(self) -> int | None:
        run = re.compile("d*").match(self.kinds, self.at).end()
        digits = "".join(self.values[self.at : run])
        self.at = run
        self.value += len(digits) != DIGITS
        if not digits:
            return None
        n = int(digits)
        self.value += n > BIN_MAX
        return n if n <= BIN_MAX else None

    def bin(self, kind: str) -> int | None:
        got = self.must(kind)
        if got is None:
            return None
        n = int(got[3:-1])
        self.value += n > BIN_MAX
        return n if n <= BIN_MAX else None


def parse(text: str) -> dict:
    """The fields of PROGRAM; never raises."""
    r = _Reading(text)
    out: dict = dict.fromkeys(x.split()[0] for x in re.sub(r"array<.*>>", "x", PROGRAM).split(", "))
    if r.must("[") is None:
        r.resume()
    else:
        candles = []
        while r.kinds[r.at] == "O":
            bins = [r.bin(k) for k in "OHLC"]
            if None not in bins:
                candles.append(dict(zip("ohlc", bins, strict=True)))
        r.value += len(candles) != INPUT_CANDLES
        out["candles"] = candles
        r.close("]")
    think = r.must("{") is not None
    if not think:
        r.resume()
    else:
        out |= {"price_in_zone": False, "good_price_action": False}
        trend = r.must("T")
        out["trend"] = trend and trend[7:-8]
        if r.must("p", value_error=True) is not None:
            out["current_price_bin"] = r.number()
            r.must("P")
        side = r.kinds[r.at]
        if side in "sr":
            r.at += 1
            low = r.number()
            r.must(":")
            high = r.number()
            r.must(side.upper())
            if low is not None and high is not None:
                out |= {"zone_direction": {"s": "support", "r": "resistance"}[side], "zone_lower": low, "zone_upper": high}
        out["price_in_zone"] = r.meet("z") is not None
        out["good_price_action"] = r.meet("g") is not None
        r.close("}")
    acting = r.must("(") is not None
    if not acting:
        r.resume()
    else:
        out["action_type"] = r.must("A")
        if r.meet("l") is not None:
            out["sl"] = r.number()
        rr = r.meet("q")
        out["rr"] = None if rr is None else int(rr[4:-1])
        r.close(")")
    if out["candles"] and out["current_price_bin"] is not None:
        r.value += out["current_price_bin"] != out["candles"][-1]["c"]
    if think and acting and out["action_type"]:
        trade = out["action_type"] in ("BUY", "SELL")
        given = [out["sl"] is not None, out["rr"] is not None, out["good_price_action"]]
        r.structural += sum(g != trade for g in given)
    r.structural += r.kinds[r.at] != END
    return out | {"n_structural": r.structural, "n_value": r.value}
