"""Price-pattern families: double bottoms and box break-outs with trade rules."""

from __future__ import annotations

from barloom.factors.common import EPS, bias, last_quarter_only, prior_mean_ratio, ratio  # noqa: F401
from barloom.factors.spec import Factor, family
from barloom.functions.cs import cs_rank
from barloom.functions.expr import Expr, close, col, high, low, open_, shift, volume
from barloom.functions.ts import ts_argmin, ts_less, ts_max, ts_min, ts_sum


def resistance(w: int) -> Expr: return ts_max(shift(high, 1), w)
def support(w: int) -> Expr: return ts_min(shift(low, 1), w)
def crossed(level: Expr) -> Expr: return (shift(close, 1) <= level) * (close > level)
def nearness(level: Expr) -> Expr: return abs(ratio(low, level)) * -1
def touched(level: Expr, tolerance: float) -> Expr: return low <= level * (1.0 + tolerance)


def score(mask: Expr, *parts: Expr) -> Expr:
    """Mean cross-sectional rank of the parts where the mask holds, else 0."""
    total = cs_rank(parts[0])
    for p in parts[1:]:
        total = total + cs_rank(p)
    return mask * total / float(len(parts))


def double_bottom(windows=(40, 60, 120), volume_windows=(5, 20), confirm_windows=(3, 5),
                  tolerance=0.02, reclaim=0.0, confirm=0.0) -> list[Factor]:
    out, tags = {}, {}
    for v in volume_windows:
        out[f"double_bottom_volume_ratio_{v}"] = prior_mean_ratio(volume, v)
    surge = prior_mean_ratio(volume, volume_windows[0])
    for w in windows:
        floor_, neck = support(w), resistance(w)
        similarity = nearness(floor_)
        breach = abs(ratio(ts_less(low, floor_), floor_)) * -1
        height = (neck - floor_) / (floor_ + EPS)
        density = ts_sum(touched(floor_, tolerance), w) / float(w)
        above, strength = ratio(close, floor_), ratio(close, neck)
        retest = touched(neck, tolerance) * (close >= neck * (1.0 + reclaim)) * (close >= open_)
        out |= {
            f"double_bottom_low_similarity_{w}": similarity, f"double_bottom_break_below_low_quality_{w}": breach,
            f"double_bottom_neckline_height_{w}": height, f"double_bottom_support_touch_density_{w}": density,
            f"double_bottom_entry_above_low_{w}": above,
            f"double_bottom_neckline_breakout_strength_{w}": crossed(neck) * strength,
            f"double_bottom_neckline_breakout_quality_{w}":
                score(crossed(neck), strength, height, similarity, density, surge),
            f"double_bottom_neckline_retest_strength_{w}": retest * strength,
            f"double_bottom_neckline_retest_quality_{w}":
                score(retest, nearness(neck), strength, height, density, surge),
        }
        for n in ("breakout_strength", "breakout_quality"):
            tags[f"double_bottom_neckline_{n}_{w}"] = "neckline_breakout"
        for n in ("retest_strength", "retest_quality"):
            tags[f"double_bottom_neckline_{n}_{w}"] = "neckline_retest"
        for c in confirm_windows:
            age = ts_argmin(shift(low, c), w) / float(w)
            second = (touched(floor_, tolerance) * (close >= open_)
                      * (close >= ts_max(shift(high, 1), c) * (1.0 + confirm)))
            named = {
                f"double_bottom_prior_low_age_{w}_{c}": age,
                f"double_bottom_second_low_confirm_strength_{w}_{c}": second * above,
                f"double_bottom_second_low_quality_{w}_{c}": score(second, similarity, breach, height, age, surge),
            }
            out |= named
            tags |= dict.fromkeys(named, "second_low")
    return family("shared", out, tags)


def box(windows=(20, 30, 60), volume_windows=(5, 20), retest_windows=(5,), tolerance=0.01, reclaim=0.0,
        min_height=0.08, min_above=0.02) -> list[Factor]:
    out, tags = {}, {}

    def add(tag: str, exprs: dict[str, Expr]) -> None:
        out.update(exprs)
        tags.update(dict.fromkeys(exprs, tag))

    for v in volume_windows:
        add("shared", {f"box_volume_ratio_{v}": prior_mean_ratio(volume, v)})
    surge = prior_mean_ratio(volume, volume_windows[0])
    body, shadow = ratio(close, open_), (high - close) / (high - low + EPS)
    for w in windows:
        top, bottom = resistance(w), support(w)
        strength, depth = ratio(close, top), nearness(top)
        height = (top - bottom) / (bottom + EPS)
        top_hits, bottom_hits = resistance_touches(w, tolerance), support_touches(w, tolerance)
        density = top_hits / float(w)
        lift = (ratio(top, shift(top, w)) + ratio(bottom, shift(bottom, w))) / 2.0
        pullback = reclaimed(top, tolerance, reclaim)
        wide = pullback * (height >= min_height)
        confirmed = wide * (strength >= min_above)
        cross = crossed(top)
        add("breakout_long", {
            f"box_breakout_strength_{w}": strength, f"box_breakout_event_strength_{w}": cross * strength,
            f"box_breakout_quality_{w}": score(cross, strength, surge, body, shadow * -1, density, lift),
        })
        for tag, stem in (("pullback_bounce", "box_pullback"), ("box_reclaim", "box_reclaim")):
            grip = f"{stem}_reclaim_strength_{w}" if tag == "pullback_bounce" else f"{stem}_strength_{w}"
            add(tag, {
                grip: pullback * strength, f"{stem}_depth_quality_{w}": depth,
                f"{stem}_quality_{w}": score(pullback, depth, strength, surge, density),
            })
        add("range_reclaim2", {
            f"box_range_reclaim2_mask_{w}": wide, f"box_range_reclaim2_confirmed_{w}": confirmed,
            f"box_range_reclaim2_close_above_resistance_pct_{w}": strength,
            f"box_range_reclaim2_box_height_pct_{w}": height, f"box_range_reclaim2_depth_quality_{w}": depth,
            f"box_range_reclaim2_support_touches_{w}": bottom_hits,
            f"box_range_reclaim2_resistance_touches_{w}": top_hits,
            f"box_range_reclaim2_strength_{w}": confirmed * strength,
            f"box_range_reclaim2_quality_{w}": score(confirmed, strength, height, depth, bottom_hits, top_hits * -1),
        })
        add("shared", {
            f"box_height_compact_{w}": height * -1, f"box_resistance_touch_density_{w}": density,
            f"box_support_touch_density_{w}": bottom_hits / float(w), f"box_stack_lift_{w}": lift,
            f"box_stack_lift_reversal_{w}": lift * -1,
        })
        for r in retest_windows:
            prior = ts_sum(shift(cross, 1), r)
            line = ts_max(shift(top, 1), r)
            retest = (prior > 0) * reclaimed(line, tolerance, reclaim)
            add("breakout_retest", {
                f"box_breakout_retest_prior_count_{w}_{r}": prior,
                f"box_breakout_retest_strength_{w}_{r}": retest * ratio(close, line),
                f"box_breakout_retest_depth_quality_{w}_{r}": nearness(line),
                f"box_breakout_retest_quality_{w}_{r}": score(
                    retest, nearness(line), ratio(close, line), surge, ts_max(shift(density, 1), r), prior),
            })
    return family("shared", out, tags)


def reclaimed(level: Expr, tolerance: float, reclaim: float) -> Expr:
    """Low dipped to the level, close is back above it, on a rising bar."""
    return touched(level, tolerance) * (close >= level * (1.0 + reclaim)) * (close >= open_)


def resistance_touches(w: int, tolerance: float) -> Expr:
    return ts_sum(high >= resistance(w) * (1.0 - tolerance), w)


def support_touches(w: int, tolerance: float) -> Expr:
    return ts_sum(touched(support(w), tolerance), w)


def trade_rules(windows=(20, 30, 60), tolerance=0.01, reclaim=0.0, min_rank=50.0, max_heat=55.0, min_support=3,
                max_resistance=3, min_rate=3.0, max_rate=6.5, min_bias=0.05, neutral_above=0.02) -> list[Factor]:
    rank_score, heat, rate = col("rank_score"), col("heat_score"), col("turnover_rate")
    regime = {r: col(f"regime_{r}") for r in ("bull_active", "range_neutral", "weak_defensive", "bear_pause", "unknown")}
    ma_bias, band = bias(close, 10), (rate >= min_rate) * (rate <= max_rate)
    out = {
        "box_rule_rank_score": rank_score, "box_rule_rank_pass": rank_score >= min_rank,
        "box_rule_heat_score": heat, "box_rule_heat_pass": heat <= max_heat,
        "box_rule_turnover_rate": rate, "box_rule_turnover_rate_band": band,
        **{f"box_rule_regime_{k}": v for k, v in regime.items()},
        "box_rule_paused_regime": regime["range_neutral"] + regime["weak_defensive"]
        + regime["bear_pause"] + regime["unknown"],
        "box_rule_ma10_bias_10": ma_bias, "box_rule_ma10_bias_pass_10": ma_bias >= min_bias,
    }
    for w in windows:
        shape = reclaimed(resistance(w), tolerance, reclaim)
        low_hits, top_hits = support_touches(w, tolerance), resistance_touches(w, tolerance)
        enough, few = low_hits >= float(min_support), top_hits <= float(max_resistance)
        out |= {
            f"box_rule_pullback_shape_{w}": shape, f"box_rule_support_touches_{w}": low_hits,
            f"box_rule_support_touches_pass_{w}": enough, f"box_rule_resistance_touches_{w}": top_hits,
            f"box_rule_resistance_touches_pass_{w}": few,
            f"box_rule_range_neutral_reclaim2_exception_{w}":
                regime["range_neutral"] * shape * (ratio(close, resistance(w)) >= neutral_above),
            f"box_rule_tradable_pullback_mask_{w}":
                regime["bull_active"] * shape * (rank_score >= min_rank) * (heat <= max_heat) * enough * few
                * band * (ma_bias >= min_bias),
        }
    return family("trade_rule", out)
