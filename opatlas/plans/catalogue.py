"""The catalogue: findings over all sources."""

from __future__ import annotations

from pyspark.sql import DataFrame

from opatlas.functions.classify import classify
from opatlas.operators import constants, findings, gates, requests, scripts
from opatlas.session import materialize


def request_partials(exchanges: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """Partial findings of request bodies, URLs and socket messages."""
    found = requests.http_exchange_items(exchanges)
    if messages is not None:
        found = found.unionByName(requests.socket_message_items(messages))
    return findings.findings_of_exchanges(found)


def script_partials(exchanges: DataFrame, include_assembled: bool = False) -> DataFrame:
    """Partial findings of script responses, every distinct bundle read once.

    ``include_assembled`` adds the operations resolved from string constants.
    """
    admitted = gates.script_captures(exchanges)
    seen = scripts.sightings(admitted)
    bundles = scripts.distinct_bundles(admitted)
    if include_assembled:
        # Read by the extractors, the constants and the chains.
        bundles = materialize(bundles)
    items = scripts.script_items(bundles)
    if include_assembled:
        items = items.unionByName(constants.assembled_items(bundles, rank=100))
    ops = findings.once_per(classify(items), ["bundle_id"])
    return findings.from_ops(scripts.at_sightings(ops, seen))


def catalogue(
    exchanges: DataFrame, messages: DataFrame, include_assembled: bool = False
) -> DataFrame:
    """All findings of a traffic log."""
    partials = request_partials(exchanges, messages).unionByName(
        script_partials(exchanges, include_assembled)
    )
    return findings.merge(partials)
