"""Detached Ed25519 signatures of packs, where the ``cryptography`` library is present."""
from __future__ import annotations

import base64
from pathlib import Path

try:
    from cryptography.exceptions import InvalidSignature
    from cryptography.hazmat.primitives import serialization
    from cryptography.hazmat.primitives.asymmetric.ed25519 import Ed25519PrivateKey, Ed25519PublicKey

    AVAILABLE = True
except ImportError:
    AVAILABLE = False


def _need() -> None:
    if not AVAILABLE:
        raise RuntimeError("signatures need the cryptography library")


def generate_keypair() -> tuple[str, str]:
    """(private, public) as Base64."""
    _need()
    key, raw = Ed25519PrivateKey.generate(), serialization.Encoding.Raw
    private = key.private_bytes(raw, serialization.PrivateFormat.Raw, serialization.NoEncryption())
    return base64.b64encode(private).decode(), base64.b64encode(key.public_key().public_bytes(raw, serialization.PublicFormat.Raw)).decode()


def sign(data: bytes, private: str) -> str:
    _need()
    return base64.b64encode(Ed25519PrivateKey.from_private_bytes(base64.b64decode(private)).sign(data)).decode()


def verify(data: bytes, signature: str, public: str) -> bool:
    _need()
    try:
        Ed25519PublicKey.from_public_bytes(base64.b64decode(public)).verify(base64.b64decode(signature), data)
        return True
    except (InvalidSignature, ValueError):
        return False


def verify_file(path: str | Path, public: str) -> bool:
    """A file against the signature beside it, in ``<name>.sig``."""
    path = Path(path)
    signature = path.with_name(path.name + ".sig")
    return path.exists() and signature.exists() and verify(path.read_bytes(), signature.read_text().strip(), public)
