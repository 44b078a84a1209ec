"""Text rules over file names, paths and messages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col

# Fixed values. Later rows win over earlier ones.
BAND_RULES = [
    ("Sub-6", ["sub-6", "sub6"]),
    ("mmWave", ["毫米波", "mmwave"]),
    ("THz", ["太赫兹", "thz"]),
    ("Optical Wireless", ["光无线", "owc", "vlc"]),
]
SCENARIO_RULES = [
    ("Satellite", ["卫星", "satellite", "leo"]),
    ("UAV", ["无人机", "uav", "drone"]),
    ("Maritime", ["海洋", "maritime", "sea"]),
    ("RIS", ["反射面", "ris", "irs"]),
    ("Industrial IoT", ["物联网", "iiot", "iot"]),
    ("ISAC", ["通感", "isac", "jcac"]),
    ("Scenario 1", ["场景 1", "scen1"]),
    ("Scenario 2", ["场景 2", "scen2"]),
    ("Scenario 3", ["场景 3", "scen3"]),
    ("Scenario 4", ["场景 4", "scen4"]),
]
BAND_DEFAULT_SCENARIO = {
    "Sub-6": "Scenario 1", "mmWave": "Scenario 2", "THz": "Scenario 3", "Optical Wireless": "Scenario 4",
}
CHANNEL_HINTS = {
    "SAGE": "sage", "CIR": "cir", "CTF": "ctf", "PDP": "pdp", "Doppler": "doppler", "Delay": "delay",
    "Angle": "angle", "Channel Matrix": "h",
}
# Tag -> substrings of a variable name; an exact name "h" also means CTF.
VARIABLE_TAGS = {
    "SAGE": ["sage"], "CIR": ["cir", "iruse", "impulse"], "CTF / Channel Matrix": ["ctf", "freq"],
    "PDP": ["pdp"], "DPSD": ["dpsd"], "Delay": ["delay", "tau"], "Angle": ["angle", "aoa", "aod"],
    "Doppler": ["doppler", "fd"],
}


def natural_key(name: str | Column, digits: int = 12) -> Column:
    """Lower-case text with every number padded to a fixed width."""
    def pad(n: Column) -> Column:
        short = F.regexp_replace(n, r"^0+(?=\d)", "")
        return F.when(F.length(short) >= digits, short).otherwise(F.lpad(short, digits, "0"))

    low = F.lower(col(name))
    numbers = F.transform(F.regexp_extract_all(low, F.lit(r"(\d+)"), F.lit(1)), pad)
    parts = F.split(low, r"\d+")
    return F.array_join(F.zip_with(parts, numbers, lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "")


def last_match(text: str | Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Label of the last rule with a matching substring; null without one."""
    low = F.lower(col(text))
    found = [F.when(_any(low, words), F.lit(label)) for label, words in reversed(rules)]
    return F.coalesce(*found)


def _any(low: Column, words: list[str]) -> Column:
    hit = low.contains(words[0])
    for w in words[1:]:
        hit = hit | low.contains(w)
    return hit


def band(text: str | Column) -> Column:
    return last_match(text, BAND_RULES)


def scenario(text: str | Column) -> Column:
    return last_match(text, SCENARIO_RULES)


def default_band(current: Column) -> Column:
    out = F.lit("Optical Wireless")
    for name in ("THz", "mmWave", "Sub-6"):
        out = F.when(current.contains(name), name).otherwise(out)
    return out


def default_scenario(band_name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in BAND_DEFAULT_SCENARIO.items() for x in kv])
    return F.coalesce(F.try_element_at(table, band_name), F.lit("Scenario 1"))


def name_tokens(stem: str | Column) -> dict[str, Column]:
    """Polarization, frequency, trajectory and time window of a measurement name."""
    tokens = F.split(col(stem), "_")
    at = F.array_position(F.transform(tokens, lambda t: F.lower(t)), "sage").cast("int")
    missing = F.lit("unspecified")

    def after(k: int) -> Column:
        return F.coalesce(F.when(at > 0, F.try_element_at(tokens, at + k)), missing)

    two = F.size(tokens) >= 2
    pol = F.when(two & F.lower(tokens[0]).startswith("pol"), F.concat_ws("_", tokens[0], F.get(tokens, F.lit(1))))
    return {"polarization": F.coalesce(pol, missing), "frequency_id": after(1), "trajectory": after(2),
            "time_window": after(3)}


def channel_hints(name: str | Column) -> Column:
    """Channel types whose pattern occurs in the name, in fixed order."""
    low = F.lower(col(name))
    return F.array_compact(F.array(*[F.when(low.contains(p), h) for h, p in CHANNEL_HINTS.items()]))


def variable_tags(name: str | Column) -> Column:
    low = F.lower(col(name))
    tags = []
    for tag, words in VARIABLE_TAGS.items():
        hit = _any(low, words)
        tags.append(F.when(hit | (low == "h") if tag.startswith("CTF") else hit, tag))
    return F.array_distinct(F.array_compact(F.array(*tags)))


def fingerprint(columns: list[str]) -> Column:
    """SHA-256 of the JSON of the defining fields."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def candidate_key(names: list[str], number: str | None = None) -> Column:
    """name=value|... with the shortest text that reads back as the same number."""
    def text(n: str) -> Column:
        x = F.col(n).cast("double")
        if number is not None:
            return F.format_string(number, x)
        whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
        return F.when(whole, x.cast("long").cast("string")).otherwise(x.cast("string"))
    return F.concat_ws("|", *[F.concat(F.lit(f"{n}="), text(n)) for n in names])


def stable_messages(messages: str | Column) -> Column:
    """Non-empty messages without repeats, in first-seen order."""
    return F.array_distinct(F.filter(col(messages), lambda m: m.isNotNull() & (F.trim(m) != "")))


def usable_text(value: str | Column) -> Column:
    """Not empty, unknown or unspecified."""
    low = F.lower(F.trim(col(value)))
    return F.coalesce(~low.isin("", "unknown", "unspecified"), F.lit(False))
