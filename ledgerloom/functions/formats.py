"""Readouts as column expressions: compact counts, cost bases, floors, states and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths of the usual limit windows, in minutes.
USUAL_MINUTES = (300, 1440, 10080, 43200, 525600)


def compact(n: Column) -> Column:
    """A count with at most two decimals in K, M or B, half up; what would round to a thousand of a unit takes the next."""
    def scaled(unit: int) -> Column:
        return F.floor((n * 100 + unit // 2) / unit).cast("long")

    def shown(cents: Column, mark: str) -> Column:
        fraction = F.lpad((cents % 100).cast("string"), 2, "0")
        return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), fraction, F.lit(mark))

    out = shown(scaled(10**9), "B")
    for unit, mark in ((10**6, "M"), (10**3, "K")):
        out = F.when(scaled(unit) < 100_000, shown(scaled(unit), mark)).otherwise(out)
    return F.when(n < 1000, n.cast("string")).otherwise(out)


def cost_basis(cost: Column, has_unpriced: Column, unattributed: Column) -> Column:
    """exact, partial (something could not be priced) or unavailable."""
    return F.when(cost.isNull(), "unavailable").when(has_unpriced | (unattributed > 0), "partial").otherwise("exact")


def is_floor(covered_from: Column, start: Column, unreadable_at: Column) -> Column:
    """Whether figures from `start` on are a lower bound: something unreadable was last written in the window, or when is unknown."""
    return covered_from.isNotNull() & (unreadable_at.isNull() | start.isNull() | (unreadable_at >= start))


def window_key(minutes: Column) -> Column:
    """The usual window within five percent, else the minutes themselves."""
    out = F.concat(F.lit("w"), minutes.cast("string"))
    for usual in reversed(USUAL_MINUTES):
        out = F.when(F.abs(minutes - usual) * 20 <= usual, f"w{usual}").otherwise(out)
    return out


def epoch(value: Column) -> Column:
    """Seconds of an epoch in seconds, milliseconds or microseconds."""
    size = F.abs(value)
    return F.when(size >= 10**15, F.floor(size / 10**6) * F.signum(value)).when(size >= 10**12, F.floor(size / 10**3) * F.signum(value)).otherwise(value).cast("long")


def iso_epoch(text: Column) -> Column:
    """Seconds of an ISO time, taken as UTC; fractions and offsets are not read, anything else is null."""
    return F.unix_timestamp(F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")))


def tone(left: Column) -> Column:
    return F.when(left > 50, "ok").when(left > 20, "low").otherwise("dry")


def basename(path: Column) -> Column:
    """The last part of a path that is not empty."""
    return F.try_element_at(F.filter(F.split(path, r"[/\\]"), lambda x: x != ""), F.lit(-1))


def absolute_project(path: Column) -> Column:
    """A path from a root, without what lies below a work tree's folder; anything else is null."""
    whole = F.regexp_replace(path, r"[/\\]\.claude[/\\]worktrees[/\\].*$", "")
    return F.when(path.rlike(r"^(/|[A-Za-z]:[/\\]|\\\\)"), whole)


def plan_label(plan: Column) -> Column:
    """A plan's name for people: wrapper words go, the others begin with a capital; a name of wrapper words alone stays."""
    words = F.filter(F.split(F.trim(F.regexp_replace(plan, "[_-]+", " ")), r"\s+"), lambda w: ~w.isin("default", "claude", ""))
    shown = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " ")
    return F.when(plan == "", None).when(F.size(words) == 0, plan).otherwise(shown)


def window_label(key: Column, source: Column) -> Column:
    """A limit window's name: struct(pool, label), the pool being what stands before a colon."""
    pool = F.when(F.instr(key, ":") > 1, F.substring_index(key, ":", 1))
    rest = F.when(pool.isNotNull(), F.substring(key, F.length(pool) + 2, F.lit(1 << 20))).otherwise(key)
    model = lambda x: F.transform(F.array(F.regexp_replace(x, "[_-]+", " ")), lambda m: F.concat(F.upper(F.substring(m, 1, 1)), F.substring(m, 2, 1 << 20)))[0]
    credits = source == "grok"
    label = (
        F.when(credits & (rest == "w10080"), "weekly credits").when(credits & (rest == "w43200"), "monthly credits").when(rest.isin("five_hour", "w300"), "session").when(rest.isin("seven_day", "w10080"), "weekly")
        .when(rest.startswith("seven_day_"), model(F.substring(rest, 11, 1 << 20))).when(rest.rlike("^w[0-9]+$"), F.concat(F.substring(rest, 2, 20), F.lit(" min"))).otherwise(model(rest))
    )
    return F.struct(pool.alias("pool"), label.alias("label"))


def nonnegative(value: Column) -> Column:
    """A whole number from a JSON value; whole doubles count, negative and other values are null."""
    number = value.try_cast("double")
    return F.when((number >= 0) & (number == F.floor(number)), number.cast("long"))


def estimate(size: Column) -> Column:
    """Tokens of so many bytes."""
    return F.floor(size / 4).cast("long")


#: Signs of currencies and their decimals; any other code stands before the amount, with a no-break space.
CURRENCIES = {"USD": ("$", 2), "EUR": ("€", 2), "GBP": ("£", 2), "HKD": ("HK$", 2), "TWD": ("NT$", 2), "CNY": ("CN¥", 2), "AUD": ("A$", 2), "CAD": ("CA$", 2), "JPY": ("¥", 0), "KRW": ("₩", 0)}
#: Signs that differ in Chinese.
CHINESE_SIGNS = {"USD": "US$", "AUD": "AU$"}
AT_LEAST = "≥ "
#: Fixed value: how a message that loads a skill begins.
SKILL_BODY = "Base directory for this skill:"


def amount(value: Column, decimals: int = 2) -> Column:
    """A number that is not negative with commas and so many decimals, half up on its shortest decimal form."""
    exact = F.greatest(value, F.lit(0.0)).cast("string").cast("decimal(38,18)")
    return F.regexp_replace(F.round(exact, decimals).cast(f"decimal(38,{decimals})").cast("string"), r"(?<=\d)(?=(?:\d{3})+(?:\.|$))(?<!\.\d{1,20})", ",")


def fixed(value: Column, decimals: int) -> Column:
    """A number with so many decimals, rounded by its exact binary value; a number that lies exactly between two takes the larger."""
    x, scale = value.cast("double"), float(10**decimals)
    between = (x * 1024 == F.floor(x * 1024)) & (x * scale - F.floor(x * scale) == 0.5)
    return F.replace(F.format_number(F.when(between, (F.floor(x * scale) + 1) / scale).otherwise(x), decimals), F.lit(","))


def money(usd: Column, currency: str = "USD", rate: float = 1.0, chinese: bool = False) -> Column:
    """Dollars in the display currency."""
    sign, decimals = CURRENCIES.get(currency, (f"{currency} ", 2))
    if chinese:
        sign = CHINESE_SIGNS.get(currency, sign)
    return F.concat(F.lit(sign), amount(usd if currency == "USD" else usd * rate, decimals))


def partial(cost: Column, has_unpriced: Column, unattributed: Column) -> Column:
    """Whether a cost is a sum over the priced tokens only."""
    return cost.isNotNull() & (has_unpriced | (unattributed > 0))


def all_unattributed(cost: Column, total: Column, unattributed: Column) -> Column:
    return cost.isNull() & (total > 0) & (unattributed == total)


def bar_title(tokens: Column, floor: Column, cost: Column, has_unpriced: Column, unattributed: Column) -> Column:
    """Tokens and cost, each marked where it is a lower bound; without a cost tokens alone."""
    mark = lambda ok: F.when(ok, AT_LEAST).otherwise("")
    shown = F.concat(mark(floor), compact(tokens))
    return F.when(cost.isNull(), shown).otherwise(F.concat(shown, F.lit(" · "), mark(partial(cost, has_unpriced, unattributed)), money(cost)))


def adaptive_cost(usd: Column) -> Column:
    """Dollars with two decimals, below a cent with as many as show it (four to eight); null is unpriced."""
    size = F.abs(usd)
    digits = F.least(F.lit(8), F.greatest(F.lit(4), F.ceil(-F.log10(size)) + 1))
    small = F.lit(None).cast("string")
    for n in range(8, 3, -1):
        small = F.when(digits == n, F.concat(F.lit("$"), amount(size, n))).otherwise(small)
    return F.when(usd.isNull(), "unpriced").when((usd != 0) & (size < 0.01), small).otherwise(F.concat(F.lit("$"), amount(size)))


def short_tokens(n: Column) -> Column:
    """Tokens in K, M or B with fewer decimals the larger they are; what rounds to a thousand takes the next unit."""
    shown = lambda unit, digits, mark: F.concat(fixed(n / unit, digits), F.lit(mark))
    mega = F.when(n >= 10**7, shown(10**6, 1, "M")).otherwise(shown(10**6, 2, "M"))
    kilo = F.when(n >= 10**5, shown(10**3, 0, "K")).otherwise(shown(10**3, 1, "K"))
    return F.when(n >= 0.9995e9, shown(10**9, 2, "B")).when(n >= 0.9995e6, mega).when(n >= 0.9995e3, kilo).otherwise(F.floor(n + 0.5).cast("string"))


def percent(share: Column) -> Column:
    return F.concat(F.when(share < 0.1, fixed(share * 100, 1)).otherwise(fixed(share * 100, 0)), F.lit("%"))


def rate_per_million(rate: Column) -> Column:
    """A rate a token as dollars a million; a dash if there is none."""
    value = (rate * 1_000_000).cast("double")
    return F.coalesce(F.concat(F.lit("$"), F.when(value < 0.1, fixed(value, 3)).otherwise(fixed(value, 2))), F.lit("—"))


def approximate_tokens(n: Column) -> Column:
    """Tokens with two significant digits in K, M or B."""
    size = F.pow(F.lit(10.0), F.greatest(F.floor(F.log10(n.cast("double"))) - 1, F.lit(0)))
    rounded = (F.floor(n / size + 0.5) * size).cast("double")
    shown = lambda unit, mark: F.concat(F.regexp_replace(F.format_string("%.1f", rounded / unit), r"\.0$", ""), F.lit(mark))
    return F.when(n < 1, "0").when(rounded >= 1e9, shown(1e9, "B")).when(rounded >= 1e6, shown(1e6, "M")).when(rounded >= 1e3, shown(1e3, "K")).otherwise(rounded.cast("long").cast("string"))


def uri_path(uri: Column) -> Column:
    """The path of a file URI with its escapes decoded; a plus sign stays one."""
    path = F.regexp_replace(uri, "^file://(localhost)?", "")
    return F.when(uri.startswith("file://"), F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))))


def model_scope(models: Column) -> Column:
    """Models as a limit stores them: 'all' for none named, else a sorted JSON list without repeats."""
    return F.when(models.isNull() | (F.size(models) == 0), "all").otherwise(F.to_json(F.array_sort(F.array_distinct(models))))


def skill_name(body: Column) -> Column:
    """The skill that a message loads, from the folder that its first line names: the last part, behind the plugin's name
    for a skill below a plugin cache (the second folder there); else null."""
    folder = F.regexp_replace(F.btrim(F.substring_index(F.regexp_extract(body, rf"^{SKILL_BODY}([^\n]*)", 1), "\r", 1)), "/+$", "")
    skill = F.nullif(F.substring_index(folder, "/", -1), F.lit(""))
    plugin = F.nullif(F.regexp_extract(folder, "/plugins/cache/[^/]*/([^/]*)", 1), F.lit(""))
    return F.when(folder.contains("/plugins/cache/"), F.concat(plugin, F.lit(":"), skill)).otherwise(skill)


def epoch_key(series: list[Column], epoch: Column) -> Column:
    """A name of one epoch of a limit's series that says nothing of the account: 16 hexadecimal digits."""
    nul = F.unhex(F.lit("00"))
    parts = [x for c in series for x in (F.coalesce(c, F.lit("")).cast("binary"), nul)]
    return F.substring(F.sha2(F.concat(*parts, F.unhex(F.lpad(F.hex(epoch), 16, "0"))), 256), 1, 16)


def legacy_key(source: Column, kind: Column, message_ms: Column, at: Column, entry_time: Column, model: Column, counts: list[Column]) -> Column:
    """The key of an entry without an id: a digest of what it says, whatever file it is in. counts end with reasoning, which
    may be null."""
    text = lambda c: F.coalesce(F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')), F.lit("null"))
    number = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    fields = [number(F.coalesce(message_ms, at * 1000)), text(entry_time), text(model), *map(number, counts)]
    return F.concat(source, F.lit(":legacy:"), kind, F.lit(":"), F.sha2(F.concat(F.lit("["), F.concat_ws(",", *fields), F.lit("]")).cast("binary"), 256))
