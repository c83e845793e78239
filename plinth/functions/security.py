"""Signed tokens (JWT with HS256) and salted password hashes (scrypt), for a front that serves the engine."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os
import time

#: Cost of the password hash (fixed values, so that stored hashes stay readable).
SCRYPT = {"n": 2**14, "r": 8, "p": 1, "dklen": 32}


def _text(raw: bytes) -> str:
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


def _raw(text: str) -> bytes:
    return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))


def _signature(key: str, signed: str) -> str:
    return _text(hmac.digest(key.encode(), signed.encode(), "sha256"))


def issue_token(key: str, subject: str, minutes: int = 60, claims: dict | None = None, now: float | None = None) -> str:
    """A token for ``subject`` that lives ``minutes``; ``claims`` go beside and before the standard ones."""
    issued = int(time.time() if now is None else now)
    parts = ({"alg": "HS256", "typ": "JWT"}, {"sub": subject, "iat": issued, "exp": issued + 60 * minutes} | (claims or {}))
    signed = ".".join(_text(json.dumps(p, separators=(",", ":")).encode()) for p in parts)
    return f"{signed}.{_signature(key, signed)}"


def verify_token(key: str, token: str, now: float | None = None) -> dict:
    """The claims of a valid token; ValueError for one that is malformed, signed with another key or expired."""
    signed, dot, signature = token.rpartition(".")
    if not dot or signed.count(".") != 1:
        raise ValueError("malformed token")
    if not hmac.compare_digest(_signature(key, signed), signature):
        raise ValueError("bad signature")
    claims = json.loads(_raw(signed.partition(".")[2]))
    if claims.get("exp", 0) < int(time.time() if now is None else now):
        raise ValueError("expired")
    return claims


def hash_password(password: str, salt: bytes | None = None) -> str:
    salt = os.urandom(16) if salt is None else salt
    return _text(salt) + "." + _text(hashlib.scrypt(password.encode(), salt=salt, **SCRYPT))


def verify_password(password: str, stored: str) -> bool:
    salt, dot, _ = stored.partition(".")
    return bool(dot) and stored.count(".") == 1 and hmac.compare_digest(hash_password(password, _raw(salt)), stored)
