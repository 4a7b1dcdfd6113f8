"""Rules that turn measures into labels, parameters and verdicts: each a column expression over one row.

Thresholds and weights are the fixed values of the rules they belong to.  A rule
reads a table of conditions from top to bottom, so a plan holds one CASE a result
and stays inside generated code; messages are codes, texts are a matter of display.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_match(rules: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first rule that holds; a null condition doesn't."""
    out = F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise
    for test, value in reversed(rules):
        out = F.when(test, value).otherwise(out)
    return out


def codes_where(rules: Sequence[tuple[str, Column]]) -> Column:
    """Names of all rules that hold, in order."""
    return F.filter(F.array(*[F.when(test, name) for name, test in rules]), lambda c: c.isNotNull())


def clipped(value: Column, low: float, high: float) -> Column:
    """Null for null, which ``least`` and ``greatest`` would pass over."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


# --- capture checks -------------------------------------------------------------

SEVERITIES = ("ok", "info", "warn", "fail")


def preflight(blur: Column, uneven: Column, high_pct: Column, low_pct: Column, value: Column, cast: Column, short_side: Column) -> Column:
    """A struct of ``severity`` (0 ok .. 3 fail), its ``name``, the ``warnings`` that led to it, and the ``action`` they suggest."""
    found = [
        ("blurred", 3, blur < 60), ("soft", 2, (blur >= 60) & (blur < 150)), ("uneven_focus", 1, (uneven > 0.6) & (blur >= 60)),
        ("highlights_lost", 3, high_pct >= 18), ("highlights_clipped", 2, (high_pct >= 8) & (high_pct < 18)),
        ("shadows_lost", 3, low_pct >= 25), ("shadows_clipped", 2, (low_pct >= 12) & (low_pct < 25)),
        ("too_dark", 3, value < 35), ("dark", 1, (value >= 35) & (value < 60)), ("too_bright", 2, value > 220),
        ("strong_cast", 2, cast >= 22), ("cast", 1, (cast >= 14) & (cast < 22)),
        ("too_small", 3, short_side < 720), ("small", 1, (short_side >= 720) & (short_side < 1080)),
    ]
    worst = F.greatest(*[F.when(test, F.lit(rank)).otherwise(F.lit(0)) for _, rank, test in found])
    held = {name: test for name, _, test in found}
    retake = first_match(
        [(held["blurred"], "retake_blur"), (held["highlights_lost"] | held["shadows_lost"], "bracket_or_retake"), (held["too_dark"] | held["dark"], "retake_dark"), (held["too_small"], "retake_small")], "retake"
    )
    action = first_match([(worst == 3, retake), (worst == 2, "review"), (worst == 1, "ok_minor")], "ok")
    names = F.array(*[F.lit(s) for s in SEVERITIES])
    return F.struct(worst.alias("severity"), F.get(names, worst).alias("name"), codes_where([(n, t) for n, _, t in found]).alias("warnings"), action.alias("action"))


# --- context and the parameters it asks for ------------------------------------------


def window_state(clipped_pct: Column, window_pct: Column) -> Column:
    return first_match(
        [(clipped_pct > 8, F.struct(F.lit("blown_severe").alias("label"), F.lit(0.7).alias("confidence"))), (clipped_pct > 2, F.struct(F.lit("blown_mild").alias("label"), F.lit(0.6).alias("confidence"))), (window_pct > 0.5, F.struct(F.lit("balanced").alias("label"), F.lit(0.55).alias("confidence")))],
        F.struct(F.lit("none").alias("label"), F.lit(0.5).alias("confidence")),
    )


def ceiling_state(cast: Column, kelvin: Column) -> Column:
    strong = F.struct(F.when(kelvin < 6000, "warm_yellow").otherwise("ambient_blue").alias("label"), F.lit(0.65).alias("confidence"))
    return first_match([(cast > 12, strong), (cast > 5, F.struct(F.lit("mixed").alias("label"), F.lit(0.55).alias("confidence")))], F.struct(F.lit("white_cool").alias("label"), F.lit(0.5).alias("confidence")))


def lighting(kelvin: Column) -> Column:
    return first_match([(kelvin < 3800, "evening_artificial"), (kelvin < 5200, "sunset_warm"), (kelvin < 7000, "daylight_natural")], "overcast")


def best_label(scores: Column) -> Column:
    """(label, score) of a map's greatest value, the first one on ties; ``unknown`` and 0 for an empty map."""
    entries = F.transform(F.map_entries(scores), lambda e, i: F.struct(e["value"].alias("score"), (-i).alias("place"), e["key"].alias("label")))
    best = F.array_max(entries)
    return F.struct(F.coalesce(best["label"], F.lit("unknown")).alias("label"), F.coalesce(best["score"], F.lit(0.0)).alias("score"))


#: Strength, knee, ceiling, chroma and guide radius of each way to treat a window.
WINDOW_PLANS = {"aggressive": (1.2, 0.48, 0.78, 1.08, 24), "moderate": (1.0, 0.55, 0.82, 1.04, 20), "gentle": (0.7, 0.65, 0.88, 1.02, 16), "skip": (0.0, 0.55, 0.82, 1.04, 20)}


def fix_parameters(
    exterior: Column, needs_window: Column, window: Column, clipped_pct: Column, sky_pct: Column, ceiling: Column, ceiling_pct: Column, needs_ceiling: Column, warm_mood: Column, light: Column, cast: Column, mood: Column
) -> Column:
    """A struct of how to treat windows and ceilings, with the ``reasons`` in the order they were decided."""
    plan = first_match(
        [(exterior | ~needs_window, "skip"), ((window == "blown_severe") | (clipped_pct > 8), "aggressive"), ((window == "blown_mild") | (clipped_pct > 2), "moderate")], "gentle"
    )
    part = lambda k: first_match([(plan == name, F.lit(values[k])) for name, values in WINDOW_PLANS.items()])
    view = (plan != "skip") & (sky_pct > 3)
    target = F.when(view, F.least(F.lit(0.92), part(2) + 0.05)).otherwise(part(2))
    no_ceiling = (ceiling == "none") | (ceiling_pct < 0.5)
    skip = no_ceiling | ~needs_ceiling
    base = first_match([(warm_mood, F.lit(0.50)), (light.isin("evening_artificial", "low_light"), F.lit(0.65)), (light == "mixed", F.lit(0.75))], F.lit(0.85))
    strength = first_match([(skip, F.lit(0.0)), (cast > 15, F.least(F.lit(1.0), base + 0.10)), (cast < 5, F.greatest(F.lit(0.30), base - 0.15))], base)
    lamps = ~skip & mood.isin("industrial", "modern_minimal")
    reasons = codes_where(
        [
            ("exterior", exterior), ("window_balanced", ~exterior & ~needs_window), ("window_aggressive", plan == "aggressive"), ("window_moderate", plan == "moderate"), ("window_gentle", plan == "gentle"), ("view_kept", view),
            ("no_ceiling", no_ceiling), ("ceiling_neutral", ~no_ceiling & ~needs_ceiling), ("warm_kept", ~skip & warm_mood), ("artificial_light", ~skip & ~warm_mood & light.isin("evening_artificial", "low_light")),
            ("daylight", ~skip & ~warm_mood & light.isin("daylight_natural", "overcast")), ("mixed_light", ~skip & ~warm_mood & (light == "mixed")), ("cast_strong", ~skip & (cast > 15)), ("cast_slight", ~skip & (cast < 5)), ("lamps", lamps),
        ]
    )
    return F.struct(
        plan.alias("window"), part(0).alias("window_strength"), part(1).alias("window_knee"), target.alias("window_target"), part(3).alias("window_chroma"), part(4).alias("window_radius"),
        skip.alias("skip_ceiling"), strength.alias("ceiling_strength"), lamps.alias("ceiling_lamps"), reasons.alias("reasons"),
    )


#: The time of day that each sky preset shows.
PRESET_TIME = {"blue_clear": "day", "blue_clouds": "day", "overcast_soft": "day", "sunset_warm": "evening", "golden_hour": "evening", "twilight_blue": "twilight", "dramatic_storm": "any"}


def sky_action(beautiful: Column, glowing: Column, glow_time: Column, preset: Column) -> Column:
    """(action, preset, overridden): a good sky stays; indoor light at dusk overrides a preset of the day."""
    time = first_match([(preset == name, t) for name, t in PRESET_TIME.items()], "day")
    override = ~beautiful & glowing & glow_time.isin("twilight", "evening") & (time == "day")
    chosen = F.when(override, F.when(glow_time == "twilight", "twilight_blue").otherwise("sunset_warm")).otherwise(preset)
    return F.struct(F.when(beautiful, "skip").otherwise("replace").alias("action"), chosen.alias("preset"), override.alias("overridden"))


def sky_class(warm: Column, saturation: Column, p90: Column, diversity: Column, blue: Column, least: float = 0.55) -> Column:
    """(category, score, beautiful) of a sky's colour measures."""
    rules = [
        ("golden_hour", (warm >= 0.18) & (saturation >= 35), 0.40 + warm * 1.5 + (saturation - 35) / 100),
        ("twilight", (warm >= 0.08) & (diversity >= 14) & (saturation >= 28), 0.35 + warm * 1.2 + diversity / 60),
        ("dramatic_clouds", (diversity >= 20) & (p90 >= 50), 0.30 + diversity / 50 + p90 / 200),
        ("vibrant_blue", (blue >= 0.55) & (saturation >= 55) & (warm < 0.05), 0.30 + (saturation - 55) / 80 + blue / 2),
    ]
    plain = first_match([(saturation < 18, "boring_grey"), ((saturation < 25) & (warm < 0.05), "washed_out")], "plain")
    score = first_match([(test, F.least(F.lit(1.0), value)) for _, test, value in rules], F.lit(0.0))
    return F.struct(first_match([(test, name) for name, test, _ in rules], plain).alias("category"), score.alias("score"), (score >= least).alias("beautiful"))


def glow_time(ratio: Column) -> Column:
    return first_match([(ratio >= 0.015, "twilight"), (ratio >= 0.005, "evening"), (ratio < 0.001, "day")], "unknown")


# --- regions ------------------------------------------------------------------------


def unit_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """A box in thousandths of the image; null where nothing lies inside."""
    scale = lambda v, n: F.rint(v / F.greatest(F.lit(1), n - 1) * 1000).cast("int")
    return F.when(x0.isNotNull(), F.struct(scale(y0, height).alias("ymin"), scale(x0, width).alias("xmin"), scale(y1, height).alias("ymax"), scale(x1, width).alias("xmax")))


def window_type(box: Column) -> Column:
    wide, high = box["xmax"] - box["xmin"], box["ymax"] - box["ymin"]
    shape = F.try_divide(wide, high)
    return first_match([((wide == 0) | (high == 0), "Unknown"), (shape > 1.8, "Sliding Window"), (shape < 0.55, "Casement Window"), (shape.between(0.85, 1.15), "Picture Window"), (shape.between(0.55, 0.85), "Casement Window")], "Standard Window")


def camera_angle(ceiling: Column, floor: Column) -> Column:
    return first_match([((ceiling > 0.35) & (floor > 0.25), "wide_angle"), (floor > 0.4, "bird_eye"), ((ceiling < 0.05) & (floor < 0.1), "close_up")], "standard")


# --- verdicts and summaries ---------------------------------------------------------------

#: Weights of the seven scores of an edit of windows and ceilings.
SCOPE_WEIGHTS = {
    "window_highlight_recovery": 0.20, "window_no_halo": 0.10, "ceiling_neutrality_lab": 0.20, "ceiling_luminance_uniform": 0.10,
    "global_consistency_psnr": 0.20, "edge_preservation_ssim": 0.10, "natural_look_chroma_balance": 0.10,
}


def scope_kept(mean_delta: Column, p99_delta: Column) -> Column:
    """Whether what should stay as it was did so."""
    return (mean_delta < 2.0) & (p99_delta < 5.0)


def scope_verdict(scores: dict[str, Column], has_window: Column, has_ceiling: Column, kept: Column) -> Column:
    """(overall, verdict, weak): nothing to treat, then an edit out of scope, come before the score."""
    overall = sum((scores[k] * w for k, w in SCOPE_WEIGHTS.items()), F.lit(0.0))
    verdict = first_match([(~has_window & ~has_ceiling, "no_target"), (~kept, "scope_violation"), (overall >= 0.85, "pass"), (overall >= 0.65, "review")], "fail")
    return F.struct(overall.alias("overall"), verdict.alias("verdict"), codes_where([(k, scores[k] < 0.6) for k in SCOPE_WEIGHTS]).alias("weak"))


def audit_summary(scene: Column, overall: Column, weak: Column) -> Column:
    """One sentence on an audit; ``weak``: names of weak categories, the weakest first."""
    first = F.replace(F.get(weak, F.lit(0)), F.lit("_"), F.lit(" "))
    return first_match(
        [
            (overall >= 9.3, F.concat(F.lit("Listing-grade "), scene, F.lit(" photo: all categories are good."))),
            (F.size(weak) == 0, F.concat(F.lit("Solid "), scene, F.lit(" photo, ready to list."))),
            (F.size(weak) == 1, F.concat(F.lit("Strong "), scene, F.lit(" photo but for "), first, F.lit("."))),
        ],
        F.concat(F.initcap(scene), F.lit(" photo with "), F.size(weak).cast("string"), F.lit(" weak categories; begin with "), first, F.lit(".")),
    )


def task_status(success: Column, message: Column) -> Column:
    return first_match([(success, "ok"), (message == "skipped", "skipped")], "fail")


def batch_summary(tasks: DataFrame, *keys: str, status: str = "status", preflight: str = "preflight", seconds: str = "seconds") -> DataFrame:
    """Counts of outcomes and capture warnings, total and mean seconds of each batch."""
    count = lambda test: F.count_if(test)
    return tasks.groupBy(*keys).agg(
        *[count(F.col(status) == s).alias(f"n_{s}") for s in ("ok", "fail", "skipped")], *[count(F.col(preflight) == s).alias(f"preflight_{s}") for s in ("warn", "fail")],
        F.sum(seconds).alias("total_seconds"), F.try_divide(F.sum(seconds), F.count(F.lit(1))).alias("mean_seconds"),
    )


def timing_summary(durations: Column, digits: int = 3) -> Column:
    """(rounded, skipped) of a map of stage durations; a null duration is a stage that was skipped."""
    ran = F.map_filter(durations, lambda k, v: v.isNotNull())
    return F.struct(F.transform_values(ran, lambda k, v: F.bround(v, digits)).alias("rounded"), F.array_sort(F.map_keys(F.map_filter(durations, lambda k, v: v.isNull()))).alias("skipped"))


# --- parameters learnt from photos that turned out well -------------------------------------

#: What a blended parameter may be.
BOUNDS = {"fine": (0.0, 0.7), "mid": (0.0, 0.7), "macro": (0.0, 0.4), "dehaze": (0.0, 0.4), "wood": (0.0, 0.8), "marble": (0.0, 0.6), "sharpen_amount": (0.0, 0.9), "sharpen_sigma": (0.5, 3.0)}
#: Where a JSON object has each of them.
PLACES = {"fine": "$.texture.fine", "mid": "$.texture.mid", "macro": "$.texture.macro", "dehaze": "$.dehaze_amount", "wood": "$.wood_clarity", "marble": "$.marble_clarity", "sharpen_amount": "$.sharpen_amount", "sharpen_sigma": "$.sharpen_sigma"}


def json_number(text: Column, place: str) -> Column:
    """The number at a place of a JSON object; true and false count 1 and 0, anything else is null."""
    value = F.try_parse_json(text)
    kind = F.schema_of_variant(F.try_variant_get(value, place, "variant"))
    number = F.try_variant_get(value, place, "double")
    return F.when(kind == "BOOLEAN", F.try_variant_get(value, place, "boolean").cast("double")).when(~kind.startswith("STRING"), number)


def blend_genes(baseline: dict[str, float], genes: DataFrame, key: str, *, params: str = "params", agent: str = "microcontrast", weight: float = 0.4) -> DataFrame:
    """``key, field, value``: each field of the baseline moved towards the mean of a key's genes, inside its bounds.

    Genes of another agent don't count; a gene without an agent is anyone's.  A key
    whose genes say nothing of a field keeps the baseline; all keys of ``genes`` are there.
    """
    tag = F.get_json_object(params, "$.agent")
    valid = F.col(params).isNotNull() & (tag.isNull() | (tag == agent))
    means = genes.groupBy(key).agg(*[F.avg(F.when(valid, json_number(F.col(params), place))).alias(name) for name, place in PLACES.items()])
    moved = {name: F.coalesce(F.lit((1 - weight) * base) + weight * F.col(name), F.lit(base)) if weight > 0 else F.lit(base) for name, base in baseline.items()}
    fields = F.array(*[F.struct(F.lit(name).alias("field"), clipped(value, *BOUNDS[name]).alias("value")) for name, value in moved.items()])
    return means.select(key, F.explode(fields).alias("f")).select(key, "f.field", "f.value")


# --- records ----------------------------------------------------------------------------------


def job_view(job_id: Column, status: Column, result_path: Column, base: str = "/v1/jobs") -> Column:
    """The address of a job's result; null until it is completed and stored."""
    return F.when((status == "completed") & result_path.isNotNull(), F.concat(F.lit(f"{base}/"), job_id.cast("string"), F.lit("/result")))


def api_key(raw: Column, prefix: str = "key") -> Column:
    """(env, body) of ``<prefix>_<env>_<32 letters or digits>``; null for anything else."""
    form = rf"^{prefix}_([a-z]+)_([0-9A-Za-z]{{32}})$"
    return F.when(raw.rlike(form), F.struct(F.regexp_extract(raw, form, 1).alias("env"), F.regexp_extract(raw, form, 2).alias("body")))


def id_and_label(stem: Column) -> Column:
    """(id, label) of ``<letters or digits>_<label>``; a stem of another form is a label without an id."""
    form = r"^([A-Za-z0-9]+?)_(.+)$"
    fits = stem.rlike(form)
    return F.struct(F.when(fits, F.regexp_extract(stem, form, 1)).otherwise("").alias("id"), F.when(fits, F.regexp_extract(stem, form, 2)).otherwise(stem).alias("label"))


PAIRINGS = {
    "angle": lambda label: label.startswith("angle_"),
    "edit": lambda label: ~label.contains("original"),
    "upscale": lambda label: label.rlike("(supir|2x|4x)"),
}


def pairings(stems: DataFrame, kind: str, *, stem: str = "stem") -> DataFrame:
    """``id, original, other, label``: each original beside its other renditions of a kind; originals without any go."""
    named = stems.select(F.col(stem).alias("stem"), id_and_label(F.col(stem)).alias("n")).select("stem", "n.id", "n.label")
    originals = named.where(F.col("label") == "original").select("id", F.col("stem").alias("original"))
    others = named.where((F.col("label") != "original") & PAIRINGS[kind](F.col("label"))).select("id", F.col("stem").alias("other"), "label")
    title = F.initcap(F.replace(F.regexp_replace("label", "^angle_", ""), F.lit("_"), F.lit(" ")))
    return originals.join(others, "id").select("id", "original", "other", title.alias("label"))


def pick_seeded(rows: DataFrame, group: str, item: str, seed: int) -> DataFrame:
    """One item of each group, by a hash of seed and item: the same for the same rows however they are dealt."""
    return rows.groupBy(group).agg(F.min_by(item, F.struct(F.xxhash64(F.lit(seed), F.col(item)), F.col(item))).alias(item))


def overrides(defaults: DataFrame, given: DataFrame, *, name: str = "name", value: str = "value") -> DataFrame:
    """``name, source, overridden``: the default of each dataset (``name, default``), or what ``given`` sets in its place."""
    new = given.select(F.col(name).alias("name"), F.col(value).alias("_value"))
    return defaults.join(new, "name", "left").select("name", F.coalesce("_value", "default").alias("source"), F.col("_value").isNotNull().alias("overridden"))
