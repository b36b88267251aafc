"""Scalar functions: sizes, dates, versions, package names, addresses."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import let

#: hosts that a download may be redirected to (fixed values)
DOWNLOAD_HOSTS = ("github.com", "release-assets.githubusercontent.com", "objects.githubusercontent.com")
VERSION = r"^(0|[1-9][0-9]{0,8})\.(0|[1-9][0-9]{0,8})\.(0|[1-9][0-9]{0,8})$"
DAY_SECONDS = 86_400


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _to_places(x: Column, places: int) -> Column:
    power = F.lit(10.0**places)
    scaled = F.abs(x) * power
    down = F.floor(scaled)
    # from 2**52 on a double has no places; infinite and no numbers stay as they are
    return F.when(scaled < F.lit(2.0**52), F.signum(x) * ((down + (scaled - down >= 0.5).cast("int")) / power)).otherwise(x)


def rounded(x: Column | str, places: int) -> Column:
    """A double to some places, halves away from zero, in doubles throughout: what is rounded to nothing keeps its sign (-0.0), as in SQL, where Spark's own has 0.0."""
    return _to_places(F.col(x), places) if isinstance(x, str) else let(x, lambda y: _to_places(y, places))


def rounded_all(v: Column | str, places: int) -> Column:
    """Each place of a vector, as a double, ``rounded``."""
    return F.transform(_c(v), lambda x: _to_places(x.cast("double"), places))


def file_size(n: Column | str) -> Column:
    """Bytes for people: GB and MB with one decimal, else whole KB."""
    n = _c(n)
    scaled = lambda unit: (n / F.lit(float(unit))).cast("double")
    return F.when(n >= 1 << 30, F.format_string("%.1f GB", scaled(1 << 30))).when(n >= 1 << 20, F.format_string("%.1f MB", scaled(1 << 20))).otherwise(F.format_string("%.0f KB", scaled(1 << 10)))


def modified_text(ms: Column | str) -> Column:
    """Epoch milliseconds as 'MMM d, yyyy'."""
    return F.date_format(F.timestamp_millis(_c(ms)), "MMM d, yyyy")


def due_daily(last: Column | str, now: Column | str) -> Column:
    """Whether a day has passed since last (or there was none)."""
    return _c(last).isNull() | (F.unix_timestamp(_c(now)) - F.unix_timestamp(_c(last)) >= DAY_SECONDS)


def eta_minutes(elapsed_ms: Column | str, done: Column | str, total: Column | str, skipped: Column | str) -> Column:
    """Whole minutes left at the rate so far, at least 1; null before anything was worked on."""
    worked = _c(done) - _c(skipped)
    seconds = F.floor(_c(elapsed_ms) * (_c(total) - _c(done)) / worked / 1000)
    return F.when(worked > 0, F.greatest(F.lit(1), F.floor((seconds + 59) / 60))).cast("long")


def throughput(changed: Column | str, elapsed_ms: Column | str) -> Column:
    """Items a second."""
    return F.when(_c(elapsed_ms) > 0, _c(changed) * 1000.0 / _c(elapsed_ms))


def cubic_weight(x: Column | str) -> Column:
    """The cubic convolution kernel with a = -0.5."""
    t = F.abs(_c(x))
    near = ((1.5 * t - 2.5) * t) * t + 1.0
    far = (((-0.5 * t + 2.5) * t) - 4.0) * t + 2.0
    return F.when(t < 1, near).when(t < 2, far).otherwise(F.lit(0.0))


def version(text: Column | str) -> Column:
    """The three numbers of a strict version as a struct, which compares in order, or null."""
    t = _c(text)
    numbers = [F.regexp_extract(t, VERSION, k + 1).try_cast("int").alias(name) for k, name in enumerate(("major", "minor", "patch"))]
    return F.when(t.rlike(VERSION) & ~t.endswith("\n"), F.struct(*numbers))


def newer(a: Column | str, b: Column | str) -> Column:
    """Whether version a is greater than version b (null: one is no version)."""
    return version(a) > version(b)


def parse_version(text: str) -> tuple[int, int, int] | None:
    m = re.fullmatch(VERSION[1:-1], text)
    return tuple(map(int, m.groups())) if m else None


#: name of a package by the pattern of its target: what follows product and release, with the groups of the pattern (fixed values)
PACKAGES = (
    (r"^(.*)-deb$", r"$1.deb"),
    (r"^(.*)-arch$", r"$1.pkg.tar.zst"),
    (r"^windows-([^-]*).*$", r"Setup-$1.exe"),
    (r"^(macos-.*)$", r"$1.dmg"),
    (r"^(.*)$", r"$1.tar.gz"),
)


def package_name(product: str, release: Column | str, target: Column | str) -> Column:
    """The file name of a release for a target such as linux-x64, linux-x64-deb, windows-x64 or macos-arm64: by the first pattern that fits."""
    t = _c(target)
    ends = [F.when(t.rlike(pattern), F.regexp_replace(t, pattern, name)) for pattern, name in PACKAGES]
    return F.concat(F.lit(f"{product}-"), _c(release), F.lit("-"), F.coalesce(*ends))


def redirect_allowed(url: Column | str, hosts: tuple[str, ...] = DOWNLOAD_HOSTS) -> Column:
    """https, a known host, no user, and the usual port."""
    u = _c(url)
    m = r"^https://([^/?#@:]+)(?::(\d*))?(?:[/?#].*)?$"
    host, port = F.lower(F.regexp_extract(u, m, 1)), F.regexp_extract(u, m, 2)
    return F.coalesce(u.rlike(m) & host.isin(*hosts) & port.isin("", "443"), F.lit(False))


def clamp(x: Column | str, low, high) -> Column:
    return F.least(F.greatest(_c(x), F.lit(low)), F.lit(high))
