"""Keys, labels, stamps and JSON of radar tables as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galewatch.schemas import OBSERVATION

TRACK_JSON = f"track_id string, site string, created_at timestamp, confirmed_at timestamp, observations array<{OBSERVATION}>"
SITE_STATE_JSON = "site string, last_status string, last_error string, activity_score int, consecutive_quiet int, consecutive_no_new int, consecutive_errors int, attempts int"


def site_key(site: Column) -> Column:
    return F.upper(F.trim(site))


def scan_key(site: Column, scan_time: Column) -> Column:
    return F.concat_ws("-", site, F.date_format(scan_time, "yyyyMMddHHmmss"))


def cell_id(key: Column, label: Column) -> Column:
    return F.format_string("%s-C%02d", key, label)


def track_id(site: Column, created_at: Column, number: Column) -> Column:
    return F.format_string("%s-%s-T%04d", site, F.date_format(created_at, "yyyyMMddHHmmss"), number)


def short_label(cell: Column) -> Column:
    return F.substring_index(cell, "-", -1)


def joined_reasons(reasons: Column) -> Column:
    return F.array_join(reasons, "; ")


def probability_label(p: Column) -> Column:
    """Four digits for tiny positive probabilities, else three."""
    return F.when((p > 0) & (p < 0.001), F.format_string("%.4f", p)).otherwise(F.format_string("%.3f", p))


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def image_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def scan_time_from_units(units: Column) -> Column:
    return F.to_timestamp(F.regexp_replace(units, "^seconds since ", ""))


def scan_date_from_filename(filename: Column) -> Column:
    return F.to_date(F.substring(filename, 5, 8), "yyyyMMdd")


def display_label(filename: Column, timezone: Column) -> Column:
    """'Mon D, H:MM AM ZONE' in the site's zone for names like KTLX20240101_023045_V06; other names stay.

    The zone's short name comes from its offset in that hour: built-in functions print only the session's zone.
    """
    name = F.upper(filename)
    stamp = F.try_to_timestamp(F.regexp_extract(name, r"^[A-Z0-9]{4}(\d{8}_\d{6})", 1), F.lit("yyyyMMdd_HHmmss"))
    zone = F.coalesce(timezone, F.lit("UTC"))
    local = F.from_utc_timestamp(stamp, zone)
    hours = ((F.unix_timestamp(local) - F.unix_timestamp(stamp)) / 3600).cast("int")
    standard = F.create_map(*[F.lit(x) for k, v in _STANDARD.items() for x in (k, v)])
    daylight = F.create_map(*[F.lit(x) for k, v in _DAYLIGHT.items() for x in (k, v)])
    winter = F.from_utc_timestamp(F.make_timestamp(F.year(stamp), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)), zone)
    base = ((F.unix_timestamp(winter) - F.unix_timestamp(F.make_timestamp(F.year(stamp), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))) / 3600).cast("int")
    short = F.when(zone == "UTC", F.lit("UTC")).when(hours == base, F.coalesce(F.element_at(standard, zone), F.element_at(standard, hours.cast("string")), F.format_string("%+03d", hours))).otherwise(F.coalesce(F.element_at(daylight, hours.cast("string")), F.format_string("%+03d", hours)))
    return F.when(stamp.isNull(), filename).otherwise(F.concat(F.date_format(local, "MMM d, h:mm a"), F.lit(" "), short))


# Short names of the zones in use, by name or else by hours from UTC.
_STANDARD = {"-10": "HST", "-9": "AKST", "-8": "PST", "-7": "MST", "-6": "CST", "-5": "EST", "-4": "AST", "Pacific/Guam": "ChST", "Asia/Seoul": "KST", "Asia/Tokyo": "JST"}
_DAYLIGHT = {"-8": "AKDT", "-7": "PDT", "-6": "MDT", "-5": "CDT", "-4": "EDT"}


def track_json(track: Column) -> Column:
    return F.to_json(track, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX"})


def track_from_json(text: Column) -> Column:
    """A stored track; what is missing in an observation gets its default."""
    t = F.from_json(text, TRACK_JSON, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX"})
    no = F.lit(False)
    filled = F.transform(
        F.coalesce(t["observations"], F.array().cast(f"array<{OBSERVATION}>")),
        lambda o: F.struct(
            o["scan_time"].alias("scan_time"), o["cell_id"].alias("cell_id"), F.coalesce(o["probability"], F.lit(0.0)).alias("probability"), F.coalesce(o["above_threshold"], no).alias("above_threshold"),
            o["x_km"].alias("x_km"), o["y_km"].alias("y_km"), o["activation_x_km"].alias("activation_x_km"), o["activation_y_km"].alias("activation_y_km"),
            F.coalesce(o["quality_pass"], no).alias("quality_pass"), F.coalesce(o["quality_reasons"], F.array().cast("array<string>")).alias("quality_reasons"), F.coalesce(o["missed"], no).alias("missed"),
        ),
    )
    return F.struct(t["track_id"].alias("track_id"), t["site"].alias("site"), t["created_at"].alias("created_at"), t["confirmed_at"].alias("confirmed_at"), filled.alias("observations"))


def site_state_from_json(text: Column) -> Column:
    s = F.from_json(text, SITE_STATE_JSON)
    counters = ("activity_score", "consecutive_quiet", "consecutive_no_new", "consecutive_errors", "attempts")
    return F.struct(s["site"].alias("site"), s["last_status"].alias("last_status"), s["last_error"].alias("last_error"), *[F.coalesce(s[c], F.lit(0)).alias(c) for c in counters])
