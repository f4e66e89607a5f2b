"""Roles of the nodes of a fleet."""

from __future__ import annotations

# Role -> part of the host name, tag on the instance.
ROLE_NAME = {"puppet": "puppetmaster", "conf": "conf", "shard": "shard", "test": "test", "test-jump": "test-jump"}
ROLE_TAG = {"puppet": "puppet", "conf": "config", "shard": "shard", "test": "test", "test-jump": "test-jump"}

# Ports of shard processes and of configuration servers.
SHARD_BASE_PORT = 27040
CONFIG_PORT = 27019

# Number of configuration servers of every cluster.
CONFIG_NODES = 3
