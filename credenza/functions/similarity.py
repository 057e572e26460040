"""Sequence similarity (no built-in) and signed tokens, as Arrow-batched functions."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio of two texts; 0 where either is empty or null."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)], dtype="float64")


def with_ratio(rows: DataFrame, a: Column, b: Column, least: float) -> DataFrame:
    """Adds `ratio` of two texts. Only texts that need it are compared in Python (the others go there as nulls, so that the
    rows' own plan is run once): equal texts have 1, texts whose lengths alone keep it below `least` and absent ones 0."""
    rows = rows.withColumns({"__a": F.coalesce(a, F.lit("")), "__b": F.coalesce(b, F.lit(""))})
    bound = F.least(F.length("__a"), F.length("__b")) * 2.0 / F.greatest(F.length("__a") + F.length("__b"), F.lit(1))
    known = F.when(F.col("__a") == F.col("__b"), F.when(F.length("__a") > 0, 1.0).otherwise(0.0)).when(bound < least, 0.0)
    rows = rows.withColumn("__known", known)
    asked = ratio(*[F.when(F.col("__known").isNull(), F.col(c)) for c in ("__a", "__b")])
    return rows.withColumn("ratio", F.coalesce("__known", asked)).drop("__a", "__b", "__known")


def signer(secret: str):
    """Column of JSON payloads to signed URL-safe tokens (payload.signature, HMAC-SHA256)."""

    @F.pandas_udf(T.StringType())
    def sign(payload: pd.Series) -> pd.Series:
        def one(p: str | None) -> str | None:
            if p is None:
                return None
            body = base64.urlsafe_b64encode(p.encode()).rstrip(b"=").decode()
            return f"{body}.{base64.urlsafe_b64encode(hmac.new(secret.encode(), body.encode(), hashlib.sha256).digest()).rstrip(b'=').decode()}"

        return payload.map(one)

    return sign


def verifier(secret: str, now: int):
    """Column of tokens to their payloads; null where the signature is wrong, exp has passed or the form is bad."""

    @F.pandas_udf(T.StringType())
    def verify(token: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                body, signature = t.split(".")
                want = base64.urlsafe_b64encode(hmac.new(secret.encode(), body.encode(), hashlib.sha256).digest()).rstrip(b"=").decode()
                payload = base64.urlsafe_b64decode(body + "=" * (-len(body) % 4)).decode()
                return payload if hmac.compare_digest(want, signature) and int(json.loads(payload)["exp"]) >= now else None
            except (AttributeError, KeyError, ValueError, TypeError):
                return None

        return token.map(one)

    return verify
