"""Rule and site settings: defaults, validation messages, gating."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.fixed import RULE_IDS, SETTINGS_MESSAGE, SETTINGS_VERSION, SITE_BY_HOST, SITE_IDS
from ..functions.lets import lookup



def _known_flags(flags: Column, ids: list[str]) -> Column:
    """A flag for every known id: the given one, or on; unknown ids are dropped."""
    keys = F.array(*[F.lit(i) for i in ids])
    given = F.coalesce(flags, F.create_map().cast("map<string,boolean>"))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(F.element_at(given, k), F.lit(True))))


def normal_rules(flags: Column) -> Column:
    return _known_flags(flags, RULE_IDS)


def normal_sites(flags: Column) -> Column:
    return _known_flags(flags, SITE_IDS)


def normal_mode(mode: Column) -> Column:
    return F.when(mode == "auto", "auto").otherwise("manual")


def disabled_rules(flags: Column) -> Column:
    """Ids that are switched off."""
    return F.map_keys(F.map_filter(flags, lambda _, on: ~on))


def _incomplete(flags: Column, ids: list[str]) -> Column:
    given = F.coalesce(flags, F.create_map().cast("map<string,boolean>"))
    return F.exists(F.array(*[F.lit(i) for i in ids]), lambda k: F.element_at(given, k).isNull())


def validation_messages(version: Column, sites: Column, rules: Column, mode: Column) -> Column:
    """What is missing or wrong in stored settings; empty means valid."""
    return F.array_compact(
        F.array(
            F.when(version.isNull() | (version != SETTINGS_VERSION), SETTINGS_MESSAGE["version"]),
            F.when(_incomplete(sites, SITE_IDS), SETTINGS_MESSAGE["sites"]),
            F.when(_incomplete(rules, RULE_IDS), SETTINGS_MESSAGE["rules"]),
            F.when(mode.isNull() | ~mode.isin("manual", "auto"), SETTINGS_MESSAGE["mode"]),
        )
    )


def site_of_url(url: Column, hosts: dict[str, str] | None = None) -> Column:
    """Site id of an address, null for an unknown host."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return lookup(SITE_BY_HOST if hosts is None else hosts, host)


def site_is_on(site: Column, enabled: Column, sites: Column) -> Column:
    """Whether scanning is on for a site: known, and neither it nor the whole is off."""
    return F.coalesce(enabled & site.isNotNull() & F.coalesce(F.element_at(sites, site), F.lit(True)), F.lit(False))
