"""Text formats of reports, logs and alerts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def ellipsis(text: Column, width: int) -> Column:
    """At most ``width`` characters; what is cut ends in an ellipsis (none below width 2)."""
    cut = F.left(text, F.lit(width)) if width <= 1 else F.concat(F.left(text, F.lit(width - 1)), F.lit("…"))
    return F.when(F.length(text) <= width, text).otherwise(cut)


def centred(text: Column, width: int) -> Column:
    left = F.floor((F.lit(width) - F.length(text)) / 2).cast("int")
    return F.when(F.length(text) >= width, text).otherwise(F.rpad(F.concat(F.repeat(F.lit(" "), left), text), width, " "))


def signed(x: Column) -> Column:
    return F.when(F.isnan(x), DASH).otherwise(F.format_string("%+.2f", x))


def percent(x: Column) -> Column:
    return F.format_string("%.2f", x)


def ratio(x: Column) -> Column:
    return F.when(x == float("inf"), "∞").when(F.isnan(x) | (x == 0), DASH).otherwise(F.format_string("%.2f", x))


def fixed(x: Column, places: int) -> Column:
    """Fixed decimals for a CSV cell, ties to even; null for null, NaN and infinities."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(finite, F.format_string(f"%.{places}f", F.bround(x, places)))


def day(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit(DASH))


def file_stem(name: Column) -> Column:
    """A name for a file: lower case, spaces and slashes as hyphens, brackets gone."""
    return F.translate(F.lower(name), " /()", "--")


def log_level(message: Column) -> Column:
    m = F.upper(message)
    return F.when(F.contains(m, F.lit("FATAL")) | F.contains(m, F.lit("ERROR")), "ERROR").when(F.contains(m, F.lit("WARN")), "WARN").otherwise("INFO")


def log_message(line: Column) -> Column:
    """The line less its prefix: what follows the first ``": "`` when that stands at place 1 to 59 (0-based)."""
    at = F.instr(line, ": ")
    bare = F.regexp_replace(line, r"[\r\n]+$", "")
    return F.when((at > 1) & (at <= 60), F.substring(bare, at + 2, F.length(bare))).otherwise(bare)


def log_record(line: Column, at: Column) -> Column:
    """A log line as a JSON object: its time, the level that its message tells, and the message."""
    message = log_message(line)
    return F.to_json(F.struct(rfc3339(at).alias("time"), log_level(message).alias("level"), message.alias("msg")))


def same_day(a: Column, b: Column, zone: str = "Asia/Kolkata") -> Column:
    return F.to_date(F.from_utc_timestamp(a, zone)) == F.to_date(F.from_utc_timestamp(b, zone))


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def signal_line(signal: Column, symbol: Column, ts: Column) -> Column:
    return F.format_string("[%s] %s | Time: %s", signal, symbol, rfc3339(ts))


def alert_payload(symbol: Column, signal: Column, ts: Column, sender: str = "Signals", green: int = 0x00C853) -> Column:
    """The alert's JSON body: a sender and one embedded card."""
    card = F.struct(
        F.concat(F.lit("📊 "), symbol).alias("title"), F.format_string("**%s** triggered the **%s** strategy.", symbol, signal).alias("description"),
        F.lit(green).alias("color"), F.struct(F.lit(f"{sender} Engine").alias("text")).alias("footer"), rfc3339(ts).alias("timestamp"),
    )
    return F.to_json(F.struct(F.lit(sender).alias("username"), F.array(card).alias("embeds")))


def notice_payload(title: Column, message: Column, warning: Column, ts: Column, sender: str = "Signals", blue: int = 0x2979FF, orange: int = 0xFF6D00) -> Column:
    """The JSON body of a message from the system itself: information, or a warning."""
    card = F.struct(
        F.concat(F.when(warning, "⚠️ ").otherwise("ℹ️ "), title).alias("title"), message.alias("description"), F.when(warning, orange).otherwise(blue).alias("color"),
        F.struct(F.lit(f"{sender} Engine").alias("text")).alias("footer"), rfc3339(ts).alias("timestamp"),
    )
    return F.to_json(F.struct(F.lit(sender).alias("username"), F.array(card).alias("embeds")))
