"""Data-quality checks as columns: request limits, effects chains and profile rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted languages and engines, and the limits of each request field.
LANGUAGES = ("zh", "en", "ja", "ko", "de", "fr", "ru", "pt", "es", "it", "he", "ar", "da", "el", "fi", "hi", "ms", "nl", "no",
             "pl", "sv", "sw", "tr")
ENGINES = ("qwen", "qwen_custom_voice", "luxtts", "chatterbox", "chatterbox_turbo", "tada", "kokoro")
CLONING_ENGINES = ("qwen", "luxtts", "chatterbox", "chatterbox_turbo", "tada")
VOICE_TYPES = ("cloned", "preset", "designed")


@dataclass(frozen=True)
class Limit:
    """What a field must satisfy; a NULL breaks only `required`."""

    field: str
    required: bool = False
    min_length: int | None = None
    max_length: int | None = None
    low: float | None = None
    high: float | None = None
    allowed: tuple[str, ...] | None = None


GENERATION_LIMITS = (
    Limit("profile_id", required=True),
    Limit("text", required=True, min_length=1, max_length=50000),
    Limit("language", allowed=LANGUAGES),
    Limit("seed", low=0),
    Limit("model_size", allowed=("1.7B", "0.6B", "1B", "3B")),
    Limit("instruct", max_length=500),
    Limit("engine", allowed=ENGINES),
    Limit("max_chunk_chars", low=100, high=5000),
    Limit("crossfade_ms", low=0, high=500),
)
PROFILE_LIMITS = (
    Limit("name", required=True, min_length=1, max_length=100),
    Limit("description", max_length=500),
    Limit("language", allowed=LANGUAGES),
    Limit("voice_type", allowed=VOICE_TYPES),
    Limit("preset_engine", max_length=50),
    Limit("preset_voice_id", max_length=100),
    Limit("design_prompt", max_length=2000),
    Limit("default_engine", max_length=50),
    Limit("personality", max_length=2000),
)
SAMPLE_LIMITS = (Limit("reference_text", required=True, min_length=1, max_length=1000),)
VOLUME_LIMITS = (Limit("volume", required=True, low=0, high=2),)
HISTORY_PAGE_LIMITS = (Limit("limit", low=1, high=100), Limit("offset", low=0))


def violations(limits: tuple[Limit, ...]) -> Column:
    """Names of the broken rules (`field:rule`), in rule order."""
    broken = []
    for rule in limits:
        c = F.col(rule.field)
        tests = [
            ("required", c.isNull() if rule.required else None),
            ("min_length", None if rule.min_length is None else F.length(c) < rule.min_length),
            ("max_length", None if rule.max_length is None else F.length(c) > rule.max_length),
            ("low", None if rule.low is None else c < rule.low),
            ("high", None if rule.high is None else c > rule.high),
            ("allowed", None if rule.allowed is None else ~c.isin(*rule.allowed)),
        ]
        broken += [F.when(t, F.lit(f"{rule.field}:{n}")) for n, t in tests if t is not None]
    return F.array_compact(F.array(*broken))


# Effect type -> parameter -> (default, lowest, highest).
EFFECTS = {
    "chorus": {"rate_hz": (1.0, 0.01, 20.0), "depth": (0.5, 0.0, 1.0), "feedback": (0.0, 0.0, 0.95),
               "centre_delay_ms": (7.0, 0.5, 50.0), "mix": (0.5, 0.0, 1.0)},
    "reverb": {"room_size": (0.5, 0.0, 1.0), "damping": (0.5, 0.0, 1.0), "wet_level": (0.33, 0.0, 1.0),
               "dry_level": (0.4, 0.0, 1.0), "width": (1.0, 0.0, 1.0)},
    "delay": {"delay_seconds": (0.3, 0.01, 2.0), "feedback": (0.3, 0.0, 0.95), "mix": (0.3, 0.0, 1.0)},
    "compressor": {"threshold_db": (-20.0, -60.0, 0.0), "ratio": (4.0, 1.0, 20.0), "attack_ms": (10.0, 0.1, 100.0),
                   "release_ms": (100.0, 10.0, 1000.0)},
    "gain": {"gain_db": (0.0, -40.0, 40.0)},
    "highpass": {"cutoff_frequency_hz": (80.0, 20.0, 8000.0)},
    "lowpass": {"cutoff_frequency_hz": (8000.0, 200.0, 20000.0)},
    "pitch_shift": {"semitones": (0.0, -12.0, 12.0)},
}


def _registry(position: int) -> Column:
    """Map `type.param` → default / lowest / highest as a constant column."""
    pairs = [F.lit(x) for e, ps in EFFECTS.items() for p, v in ps.items() for x in (f"{e}.{p}", v[position])]
    return F.create_map(*pairs)


def chain_error(chain: Column) -> Column:
    """First problem of an effects chain `array<struct<type, enabled, params: map<string, string>>>`, or NULL.

    Parameter values are JSON scalars as text, so a quoted number is not a number.
    """
    low, high = _registry(1), _registry(2)

    def param_error(effect: Column, index: Column, entry: Column) -> Column:
        key = F.concat(effect["type"], F.lit("."), entry["key"])
        where = F.concat(F.lit("Effect '"), effect["type"], F.lit("' at index "), index.cast("string"), F.lit(": "))
        value = entry["value"].try_cast("double")
        return F.when(~F.map_contains_key(low, key),
                      F.concat(where, F.lit("unknown param '"), entry["key"], F.lit("'"))).when(
            value.isNull(), F.concat(where, F.lit("param '"), entry["key"], F.lit("' must be a number"))).when(
            (value < F.try_element_at(low, key)) | (value > F.try_element_at(high, key)),
            F.concat(where, F.lit("param '"), entry["key"], F.lit("' must be between "),
                     F.try_element_at(low, key).cast("string"), F.lit(" and "),
                     F.try_element_at(high, key).cast("string"), F.lit(" (got "), entry["value"], F.lit(")")))

    def effect_error(effect: Column, index: Column) -> Column:
        unknown = ~effect["type"].isin(*EFFECTS)
        errors = F.transform(F.map_entries(effect["params"]), lambda e: param_error(effect, index, e))
        return F.when(unknown, F.concat(F.lit("Unknown effect type '"), effect["type"], F.lit("' at index "),
                                        index.cast("string"))).otherwise(F.get(F.array_compact(errors), F.lit(0)))

    return F.get(F.array_compact(F.transform(chain, effect_error)), F.lit(0))


def effective_params(df: DataFrame, key: str, chain: str) -> DataFrame:
    """One row per parameter of every enabled effect: the given value, else the default."""
    names = F.create_map(*[x for e, ps in EFFECTS.items() for x in (F.lit(e), F.array(*map(F.lit, ps)))])
    effects = df.select(key, F.posexplode(chain).alias("pos", "effect")).filter(
        F.coalesce(F.col("effect.enabled"), F.lit(True)))
    rows = effects.select(key, "pos", F.col("effect.type").alias("effect"), F.col("effect.params").alias("given"),
                          F.explode(F.try_element_at(names, F.col("effect.type"))).alias("param"))
    default = F.try_element_at(_registry(0), F.concat("effect", F.lit("."), "param"))
    return rows.select(key, "pos", "effect", "param", F.coalesce(
        F.try_element_at("given", F.col("param")).try_cast("double"), default).alias("value"))


def profile_error(profiles: DataFrame, preset_voices: DataFrame) -> DataFrame:
    """First broken rule of each profile by its kind, NULL when valid."""
    engines = preset_voices.select(F.col("engine").alias("preset_engine"), F.lit(True).alias("__known")).distinct()
    pairs = preset_voices.select(F.col("engine").alias("preset_engine"), F.col("voice_id").alias("preset_voice_id"),
                                 F.lit(True).alias("__pair")).distinct()
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    joined = profiles.join(engines, "preset_engine", "left").join(
        pairs, ["preset_engine", "preset_voice_id"], "left")
    kind = F.coalesce("voice_type", F.lit("cloned"))
    preset = F.when(~has("preset_engine") | ~has("preset_voice_id"),
                    "Preset profiles require both preset_engine and preset_voice_id").when(
        has("default_engine") & (F.col("default_engine") != F.col("preset_engine")),
        "Preset profiles must use their preset_engine as default_engine").when(
        F.col("__known") & F.col("__pair").isNull(),
        F.concat(F.lit("Preset voice '"), "preset_voice_id", F.lit("' is not valid for engine '"), "preset_engine",
                 F.lit("'")))
    designed = F.when(F.trim(F.coalesce("design_prompt", F.lit(""))) == "",
                      "Designed profiles require a design_prompt").when(
        has("preset_engine") | has("preset_voice_id"),
        "Designed profiles cannot set preset_engine or preset_voice_id")
    cloned = F.when(has("preset_engine") | has("preset_voice_id"),
                    "Cloned profiles cannot set preset_engine or preset_voice_id").when(
        has("design_prompt"), "Cloned profiles cannot set design_prompt").when(
        has("default_engine") & ~F.col("default_engine").isin(*CLONING_ENGINES),
        F.concat(F.lit("Cloned profiles cannot use default engine '"), "default_engine", F.lit("'")))
    error = F.when(kind == "preset", preset).when(kind == "designed", designed).otherwise(cloned)
    return joined.withColumn("error", error).drop("__known", "__pair")


def engine_error(kind: Column, preset_engine: Column, preset_voice: Column, prompt: Column, engine: Column) -> Column:
    """Can a profile of this kind be used with the requested engine?  NULL when it can."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.when(kind == "preset", F.when(empty(preset_engine) | empty(preset_voice), "missing preset engine").when(
        preset_engine != engine, "other engine")).when(
        kind == "designed", F.when(F.trim(F.coalesce(prompt, F.lit(""))) == "", "missing design prompt")).otherwise(
        F.when(~engine.isin(*CLONING_ENGINES), "engine cannot clone"))
