"""Checks and guards that keep page images on the machine."""

from __future__ import annotations

import ipaddress
import os
import socket
from contextlib import contextmanager
from urllib.parse import urlparse

#: Variables that route traffic away or point at cloud services.
PROXY_VARS = ("HTTP_PROXY", "HTTPS_PROXY", "ALL_PROXY", "http_proxy", "https_proxy", "all_proxy")
CLOUD_VARS = (
    "OPENAI_API_KEY", "OPENAI_BASE_URL", "ANTHROPIC_API_KEY", "AZURE_OPENAI_ENDPOINT", "GOOGLE_API_KEY",
    "GEMINI_API_KEY", "AWS_BEDROCK_ENDPOINT", "MISTRAL_API_KEY", "COHERE_API_KEY",
)


class Blocked(RuntimeError):
    pass


class NotOffline(RuntimeError):
    pass


def is_local(host: str) -> bool:
    if host in ("localhost", "localhost.localdomain"):
        return True
    try:
        return ipaddress.ip_address(host).is_loopback
    except ValueError:
        return False


def problems(server_url: str, allow_hosts=(), env=None) -> list[str]:
    """What about the environment suggests that data could leave."""
    env = os.environ if env is None else env
    out = [f"{v} is a proxy elsewhere" for v in PROXY_VARS if env.get(v) and not is_local(urlparse(env[v]).hostname or "")]
    out += [f"{v} is set" for v in CLOUD_VARS if env.get(v)]
    host = urlparse(server_url).hostname or ""
    if not is_local(host) and host not in set(allow_hosts):
        out.append(f"server '{host}' is neither loopback nor allowed")
    return out


def assert_offline(server_url: str, allow_hosts=(), env=None) -> None:
    if found := problems(server_url, allow_hosts, env):
        raise NotOffline("; ".join(found))


@contextmanager
def outbound_only(allow_hosts=()):
    """No connections but to loopback and allowed hosts.  Meant for Python
    workers; in a driver it would cut Spark's own connections."""
    allowed = {h.lower() for h in allow_hosts}
    held = {name: getattr(socket.socket, name) for name in ("connect", "connect_ex")}

    def guard(real):
        def call(self, address):
            host = str(address[0]) if isinstance(address, tuple) and address else "localhost"
            if not is_local(host) and host.lower() not in allowed:
                raise Blocked(f"connection to {host} is not allowed")
            return real(self, address)

        return call

    for name, real in held.items():
        setattr(socket.socket, name, guard(real))
    try:
        yield
    finally:
        for name, real in held.items():
            setattr(socket.socket, name, real)
