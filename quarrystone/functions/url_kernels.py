"""Address blocks and robots rules by the standard library, as Arrow-batched UDFs."""

from __future__ import annotations

import ipaddress
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType


#: Protocol assignments: releases of the standard library differ in which of them they call global, here none is.
_ASSIGNED = ipaddress.ip_network("192.0.0.0/24")


def address_verdict(address: str, private_allowed: bool = False) -> str:
    """``blocked``, ``private`` (blocked unless allowed) or ``allowed`` for a resolved address."""
    try:
        ip = ipaddress.ip_address(address)
    except ValueError:
        return "blocked"
    ip = getattr(ip, "ipv4_mapped", None) or ip
    if ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified:
        return "blocked"
    return "allowed" if (ip.is_global and ip not in _ASSIGNED) or private_allowed else "private"


def outbound_verdict(private_allowed: bool = False):
    @F.pandas_udf(StringType())
    def run(addresses: pd.Series) -> pd.Series:
        return addresses.map(lambda a: address_verdict(a or "", private_allowed))

    return run


def robots_allowed(rules: str, agent: str = "*"):
    """Whether a robots file lets the agent fetch a page; the rules are one short text."""

    @F.pandas_udf(BooleanType())
    def run(urls: pd.Series) -> pd.Series:
        parser = RobotFileParser()
        parser.parse(rules.splitlines())
        return urls.map(lambda u: u is not None and parser.can_fetch(agent, u))

    return run
