"""HMAC-SHA-256 as native Spark expressions (H7).

HMAC(key, m) = H((K ^ opad) || H((K ^ ipad) || m)) with a 64-byte block. The two
padded keys are computed once on the driver and enter the plan as literals, so
the whole check stays inside whole-stage codegen. Because the pads are visible in
the query plan, a deployment with a real secret uses ``hmac_sha256_udf``, which
reads the secret on the executor from an environment variable instead.
"""

from __future__ import annotations

import hashlib
import os

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def _pads(key: str) -> tuple[bytes, bytes]:
    raw = key.encode("utf-8")
    if len(raw) > _BLOCK:
        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(_BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)


def hmac_sha256_hex(key: str, message: Column) -> Column:
    """Lower-case hex HMAC-SHA-256 of a binary column."""
    ipad, opad = _pads(key)
    inner = F.unhex(F.sha2(F.concat(F.unhex(F.lit(ipad.hex())), message), 256))
    return F.sha2(F.concat(F.unhex(F.lit(opad.hex())), inner), 256)


def verify_signature(key: str | None, body: Column, signature: Column) -> Column:
    """True iff key and signature are present, the prefix is ``sha256=`` and the MAC matches.

    Null-safe: a missing header gives false, never null.
    """
    if not key:
        return F.lit(False)
    expected = F.concat(F.lit("sha256="), hmac_sha256_hex(key, body))
    return F.coalesce(signature.startswith("sha256=") & (signature == expected), F.lit(False))


def hmac_sha256_udf(secret_env: str = "FEEDMINE_WEBHOOK_SECRET", secret_file: str | None = None):
    """Executor-side variant: the secret never enters the plan.

    The secret is read on the executor, from ``secret_file`` (a mounted secret) when
    given, else from the environment variable ``secret_env`` (set on executors with
    ``spark.executorEnv.<name>``).
    """
    import hmac as _hmac

    @F.pandas_udf("boolean")
    def _verify(body: pd.Series, signature: pd.Series) -> pd.Series:
        if secret_file:
            with open(secret_file, encoding="utf-8") as fh:
                secret = fh.read().strip()
        else:
            secret = os.environ.get(secret_env, "")
        out = []
        for b, s in zip(body, signature):
            if not secret or s is None or b is None or not s.startswith("sha256="):
                out.append(False)
                continue
            mac = _hmac.new(secret.encode("utf-8"), bytes(b), hashlib.sha256).hexdigest()
            out.append(_hmac.compare_digest(s, "sha256=" + mac))
        return pd.Series(out, dtype=bool)

    return _verify
