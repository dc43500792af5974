"""Round configurations: fixed, checked on construction, read from and written to JSON."""

from __future__ import annotations

import json
import os
from dataclasses import astuple, dataclass

GROUP_OF_ACTION = {
    "HOLD": "HOLD", "BUY": "BUY", "SELL": "SELL", "CANCEL_BUY": "CANCEL", "CANCEL_SELL": "CANCEL", "WAIT_BUY": "WAIT", "WAIT_SELL": "WAIT",
}
GROUPS = ("HOLD", "BUY", "SELL", "CANCEL", "WAIT")
WELL_FORMED, GATE_PASSED = 1.0, 2.0


TRADES = ("BUY", "SELL")
ACTION_GROUPS = ("HOLD", "BUY", "SELL", "CANCEL_BUY", "CANCEL_SELL", "WAIT_BUY", "WAIT_SELL")
ZONE_GROUPS = ("HAS_ZONE", "NO_ZONE")

Range = tuple[float, float]


@dataclass(frozen=True)
class Gain:
    """How a controller follows its target: weight of the past, proportional and differential gain, largest step."""

    alpha: float = 0.9
    kp: float = 0.02
    kd: float = 0.01
    step_max: float = 0.0005

    def faults(self, name: str) -> list[str]:
        out = [] if 0 <= self.alpha < 1 else [f"{name}: alpha {self.alpha} is outside [0, 1)"]
        return out + [f"{name}: {k} {v} is below 0" for k, v in (("kp", self.kp), ("kd", self.kd), ("step_max", self.step_max)) if v < 0]


@dataclass(frozen=True)
class Entropy:
    """The one-sided controller of rr's entropy: floor, gains and the largest bonus."""

    floor: float = 0.3
    gain: Gain = Gain()
    cap: float = 0.1

    def faults(self) -> list[str]:
        return self.gain.faults("entropy") + [f"entropy: {k} {v} is below 0" for k, v in (("floor", self.floor), ("cap", self.cap)) if v < 0]


def _range_faults(name: str, limits: Range, init: float) -> list[str]:
    low, high = limits
    if low > high:
        return [f"{name}: {low} is above {high}"]
    return [] if low <= init <= high else [f"{name}: init {init} is outside {low}..{high}"]


def _below_zero(config, *names: str) -> list[str]:
    return [f"{n} {getattr(config, n)} is below 0" for n in names if getattr(config, n) < 0]


def _refuse(round_id: str, faults: list[str]) -> None:
    if faults:
        raise ValueError(f"{round_id}: " + "; ".join(faults))


@dataclass(frozen=True)
class RoundOne:
    """One task, five action groups. WAIT takes what the other targets leave."""

    round_id: str
    targets: dict[str, float]
    ranges: dict[str, Range]
    init: dict[str, float]
    zone_width: tuple[int, int] = (5, 20)
    sl_distance: tuple[int, int] = (5, 20)
    pass_bonus: float = 4.5
    zone_scale: float = 0.0
    sl_bonus: float = 0.2
    sl_penalty: float = 0.2
    fee_bins: float = 0.65
    gain: Gain = Gain()
    entropy: Entropy = Entropy()

    def __post_init__(self):
        total = sum(self.targets.values())
        faults = [] if 0 <= total <= 1 else [f"targets sum to {total}, outside [0, 1]"]
        for g in GROUPS:
            faults += _range_faults(g, self.ranges[g], self.init[g])
        faults += self.gain.faults("buffs") + self.entropy.faults()
        faults += _below_zero(self, "zone_scale", "sl_bonus", "sl_penalty", "fee_bins")
        if self.sl_distance[0] <= 0:
            faults.append(f"the least stop distance {self.sl_distance[0]} is not above 0")
        else:
            faults += [f"{g}: the worst pass {w} does not beat the best failure {self.best_failure}" for g in GROUPS if (w := self.worst_pass(g)) <= self.best_failure]
        _refuse(self.round_id, faults)

    @property
    def best_failure(self) -> float:
        return GATE_PASSED + self.sl_bonus

    def worst_pass(self, group: str) -> float:
        """The least reward of a pass: no zone for HOLD, else the worst zone score; for trades also a full loss and the fee at the least stop."""
        zone = 0.0 if group == "HOLD" else -self.zone_scale
        trade = -1 - self.fee_bins / self.sl_distance[0] if group in TRADES else 0.0
        return self.pass_bonus + zone + trade + self.ranges[group][0]

    def target(self, group: str) -> float:
        return 1 - sum(self.targets.values()) if group == "WAIT" else self.targets[group]


@dataclass(frozen=True)
class RoundTwo:
    """Two tasks: seven action groups, whose targets add up to 1, and two zone groups, whose targets follow from HOLD's."""

    round_id: str
    targets: dict[str, float]
    ranges: dict[str, Range]
    init: dict[str, float]
    zone_ranges: dict[str, Range]
    zone_init: dict[str, float]
    zone_width: tuple[int, int] = (10, 40)
    sl_distance: tuple[int, int] = (5, 20)
    fee_bins: float = 0.65
    entry_weight: float = 0.2
    gain: Gain = Gain(kp=0.01)
    zone_gain: Gain = Gain(kp=0.01)
    entropy: Entropy = Entropy()
    pass_bonus: float = 4.5
    zone_scale: float = 0.1

    def __post_init__(self):
        faults = [f"{g}: target {t} is outside [0, 1]" for g, t in self.targets.items() if not 0 <= t <= 1]
        total = sum(self.targets.values())
        if abs(total - 1) > 1e-6:
            faults.append(f"targets sum to {total}, not 1")
        for g in ACTION_GROUPS:
            faults += _range_faults(g, self.ranges[g], self.init[g])
        for g in ZONE_GROUPS:
            faults += _range_faults(g, self.zone_ranges[g], self.zone_init[g])
        if not 0 <= self.entry_weight <= 2:
            faults.append(f"entry_weight {self.entry_weight} is outside [0, 2]")
        if self.sl_distance[0] <= 0:
            faults.append(f"the least stop distance {self.sl_distance[0]} is not above 0")
        faults += _below_zero(self, "fee_bins") + self.gain.faults("action") + self.zone_gain.faults("zone") + self.entropy.faults()
        _refuse(self.round_id, faults)

    def target(self, namespace: str, group: str) -> float:
        if namespace == "zone":
            return self.targets["HOLD"] if group == "NO_ZONE" else 1 - self.targets["HOLD"]
        return self.targets[group]

    def settings(self) -> list[tuple]:
        """(namespace, grp, target, low, high, init, alpha, kp, kd, step_max) of each group."""
        action = [("action", g, self.target("action", g), *self.ranges[g], self.init[g], *astuple(self.gain)) for g in ACTION_GROUPS]
        return action + [("zone", g, self.target("zone", g), *self.zone_ranges[g], self.zone_init[g], *astuple(self.zone_gain)) for g in ZONE_GROUPS]


SETTINGS = "namespace string, grp string, target double, low double, high double, init double, alpha double, kp double, kd double, step_max double"


def settings(config: RoundOne | RoundTwo) -> list[tuple]:
    """Rows of SETTINGS. A round with one task has one namespace."""
    if isinstance(config, RoundTwo):
        return config.settings()
    return [("action", g, config.target(g), *config.ranges[g], config.init[g], *astuple(config.gain)) for g in GROUPS]


def _of_five(trade, other) -> dict:
    return {g: trade if g in TRADES else other for g in GROUPS}


def _of_seven(trade, other) -> dict:
    return {g: trade if g in TRADES else other for g in ACTION_GROUPS}


# Fixed values of the three rounds.
ROUND1 = RoundOne("round1", {"HOLD": 0.06, "BUY": 0.28, "SELL": 0.28, "CANCEL": 0.19}, _of_five((0.15, 0.35), (0.0, 0.10)), _of_five(0.20, 0.0))
ROUND2 = RoundOne("round2", {"HOLD": 0.06, "BUY": 0.24, "SELL": 0.24, "CANCEL": 0.23}, _of_five((0.15, 0.20), (0.0, 0.05)), _of_five(0.15, 0.0), gain=Gain(step_max=0.0002))
ROUND1_V2 = RoundTwo(
    "round1_v2",
    {"HOLD": 0.10, "BUY": 0.16, "SELL": 0.16, "CANCEL_BUY": 0.1, "CANCEL_SELL": 0.1, "WAIT_BUY": 0.19, "WAIT_SELL": 0.19},
    _of_seven((0.0, 1.0), (0.0, 1.0)), _of_seven(0.20, 0.0), dict.fromkeys(ZONE_GROUPS, (0.0, 0.30)), dict.fromkeys(ZONE_GROUPS, 0.0),
)


class _Flat:
    """A round's flat file: each key read once, missing keys gathered, numbers cast; the same walk writes it."""

    def __init__(self, given: dict | None = None):
        self.given, self.missing, self.out = given, [], {}

    def key(self, name: str, cast: type, value=None, default=None):
        """Reading: the value under ``name``, cast (``default`` where it may be left out). Writing: notes it."""
        if self.given is None:
            self.out[name] = value
            return value
        if self.given.get(name) is None:
            if default is None:
                self.missing.append(name)
            return default
        return cast(self.given[name])

    def pair(self, low: str, high: str, cast: type, value=(None, None)) -> tuple:
        return self.key(low, cast, value[0]), self.key(high, cast, value[1])

    def gain(self, prefix: str, names: tuple[str, str, str, str], value: Gain | None) -> tuple:
        own = astuple(value) if value else (None,) * 4
        return tuple(self.key(f"{prefix}{n}", float, v) for n, v in zip(names, own, strict=True))

    def groups(self, prefix: str, names: tuple[str, ...], ranges: dict | None, init: dict | None) -> tuple[dict, dict]:
        """Ranges and initial values; an initial value may be left out and is then the range's lower end."""
        r = {g: self.pair(f"{prefix}{g.lower()}_buff_min", f"{prefix}{g.lower()}_buff_max", float, ranges[g] if ranges else (None, None)) for g in names}
        return r, {g: self.key(f"{prefix}{g.lower()}_buff_init", float, init[g] if init else None, default=r[g][0] if r[g][0] is not None else 0.0) for g in names}


_BUFF_GAIN = ("ema_alpha", "buff_kp", "buff_kd", "buff_step_max")
_ENTROPY_GAIN = ("ema_alpha", "kp", "kd", "bonus_step_max")


def _common(f: _Flat, c) -> dict:
    e = c.entropy if c else None
    return {
        "round_id": f.key("round_id", str, c and c.round_id),
        "zone_width": f.pair("zone_width_min_bins", "zone_width_max_bins", int, c.zone_width if c else (None, None)),
        "sl_distance": f.pair("sl_min_dist_bins", "sl_max_dist_bins", int, c.sl_distance if c else (None, None)),
        "fee_bins": f.key("trade_fee_bins", float, c and c.fee_bins),
        "entropy": (f.key("rr_entropy_floor", float, e and e.floor), f.gain("rr_entropy_", _ENTROPY_GAIN, e and e.gain), f.key("rr_entropy_bonus_cap", float, e and e.cap)),
    }


def _round_one(f: _Flat, c: RoundOne | None) -> dict:
    ranges, init = f.groups("", GROUPS, c and c.ranges, c and c.init)
    named = {"pass_bonus": "pass_gate2_bonus", "zone_scale": "zone_score_scale", "sl_bonus": "sl_valid_bonus", "sl_penalty": "sl_valid_penalty"}
    return (
        _common(f, c)
        | {own: f.key(name, float, getattr(c, own) if c else None) for own, name in named.items()}
        | {"targets": {g: f.key(f"target_{g.lower()}_ratio", float, c.targets[g] if c else None) for g in GROUPS if g != "WAIT"}}
        | {"ranges": ranges, "init": init, "gain": f.gain("", _BUFF_GAIN, c and c.gain)}
    )


def _round_two(f: _Flat, c: RoundTwo | None) -> dict:
    ranges, init = f.groups("action_", ACTION_GROUPS, c and c.ranges, c and c.init)
    zone_ranges, zone_init = f.groups("zone_", ZONE_GROUPS, c and c.zone_ranges, c and c.zone_init)
    return (
        _common(f, c)
        | {"entry_weight": f.key("entry_score_weight", float, c and c.entry_weight)}
        | {"targets": {g: f.key(f"action_{g.lower()}_target_ratio", float, c.targets[g] if c else None) for g in ACTION_GROUPS}}
        | {"ranges": ranges, "init": init, "zone_ranges": zone_ranges, "zone_init": zone_init}
        | {"gain": f.gain("action_", _BUFF_GAIN, c and c.gain), "zone_gain": f.gain("zone_", _BUFF_GAIN, c and c.zone_gain)}
    )


_SHAPES = {RoundOne: _round_one, RoundTwo: _round_two}


def save(config: RoundOne | RoundTwo, path: str) -> None:
    """Writes the flat file; folders above it are made."""
    f = _Flat()
    _SHAPES[type(config)](f, config)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        json.dump(f.out, out, indent=2, ensure_ascii=False)


def load(kind: type, path: str) -> RoundOne | RoundTwo:
    """In order: the file must exist, no required key may be missing, values must cast, invariants must hold. Other keys are passed over."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    with open(path, encoding="utf-8") as file:
        f = _Flat(json.load(file))
    read = _SHAPES[kind](f, None)
    if f.missing:
        raise ValueError(f"missing keys: {', '.join(sorted(f.missing))}")
    floor, gain, cap = read["entropy"]
    read |= {"entropy": Entropy(floor, Gain(*gain), cap)} | {k: Gain(*read[k]) for k in ("gain", "zone_gain") if k in read}
    return kind(**read)


#: Name, hidden size, layers, attention heads, key-value heads, feed-forward size.
MODEL_SIZES = [("tiny", 128, 4, 4, 2, 512), ("small", 256, 6, 8, 4, 1024), ("base", 512, 8, 8, 4, 2048), ("large", 768, 12, 12, 4, 3072)]
