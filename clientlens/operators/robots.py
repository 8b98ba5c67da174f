"""robots.txt: groups, rules and whether clients keep to them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse(text: str) -> list[tuple[str, bool, str]]:
    """(agent, allow, pattern) rules; agents lower-cased, "*" for all."""
    out, agents, open_group = [], [], False
    for line in text[: 512 << 10].splitlines():
        key, _, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            agents = [*agents, value.lower()] if open_group else [value.lower()]
            open_group = True
        elif key in ("allow", "disallow"):
            open_group = False
            if value:
                out += [(a, key == "allow", value) for a in agents]
    return out


def as_regex(rule: str) -> str:
    """``*`` matches anything, a final ``$`` the end."""
    end = rule.endswith("$")
    body = ".*".join(re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", p) for p in rule.rstrip("$").split("*"))
    return f"^{body}{'$' if end else ''}"


def disallowed(product: Column, path: Column, rules: list[tuple[str, bool, str]]) -> Column:
    """True if the rules of the longest agent name in ``product`` (else of "*")
    forbid ``path``: the longest matching rule decides, Allow wins a tie."""
    names = sorted({a for a, _, _ in rules if a != "*"}, key=lambda a: (-len(a), a))

    def verdict(agent: str) -> Column:
        best = F.lit(None).cast("boolean")
        ordered = sorted((r for r in rules if r[0] == agent), key=lambda r: (len(r[2]), r[1]))
        for _, allow, rule in ordered:  # later, that is longer or allowing, rules win
            best = F.when(path.rlike(as_regex(rule)), F.lit(not allow)).otherwise(best)
        return F.coalesce(best, F.lit(False))

    out = verdict("*")
    for a in reversed(names):
        out = F.when(F.coalesce(product.contains(a), F.lit(False)), verdict(a)).otherwise(out)
    return F.when(path == "", F.lit(False)).otherwise(out)


def compliance(flagged: DataFrame, rules: list[tuple[str, bool, str]], keys: list[str]) -> DataFrame:
    """(client, disallowed_hits, verdict): ignores with any hit, respects if it
    fetched robots.txt or asked five times, else unknown."""
    bad = ~F.col("robots_file") & disallowed(F.col("product"), F.col("path"), rules)  # robots.txt itself is always open
    g = flagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("disallowed_hits"), F.bool_or("robots_file").alias("fetched"))
    v = F.when(F.col("disallowed_hits") > 0, "ignores").when(F.lit(bool(rules)) & (F.col("fetched") | (F.col("n") >= 5)), "respects").otherwise("unknown")
    return g.select(*keys, "disallowed_hits", v.alias("verdict"))


def groups(text: str) -> list[tuple[str, int | None]]:
    """(agent, seconds between requests or None) of each group's agents, in the order
    of the file; agents as they are written."""
    out: list[list] = []
    agents: list[list] = []
    open_group = False
    for line in text[: 512 << 10].splitlines():
        key, _, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            agents = agents if open_group else []
            agents.append([value, None])
            out.append(agents[-1])
            open_group = True
        elif key in ("allow", "disallow", "crawl-delay"):
            open_group = False
            if key == "crawl-delay" and value.isdigit():
                for a in agents:
                    a[1] = int(value)
    return [(a, d) for a, d in out]


def with_delay(clients: DataFrame, text: str) -> DataFrame:
    """Adds crawl_delay, delay_respected and matched_group to ``clients`` (product,
    iat_median).

    Both go by the first group in the file whose name the product holds, else by "*":
    this is what is shown, and may be another group than the longest name, whose
    rules :func:`compliance` judges by.
    """
    own = [(a, d) for a, d in groups(text) if a != "*"]
    rest = [d for a, d in groups(text) if a == "*"]
    product = F.lower("product")
    delay = F.lit(rest[0] if rest else None).cast("double")
    name = F.lit("*" if rest else None).cast("string")
    for a, d in reversed(own):
        fits = F.coalesce(F.contains(product, F.lit(a.lower())), F.lit(False))
        delay, name = F.when(fits, F.lit(d).cast("double")).otherwise(delay), F.when(fits, F.lit(a)).otherwise(name)
    d = clients.withColumns({"crawl_delay": delay, "matched_group": name})
    return d.withColumn("delay_respected", F.col("iat_median") >= F.col("crawl_delay"))
