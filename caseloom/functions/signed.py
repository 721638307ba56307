"""HMAC-SHA-256, signed tokens and signed URLs as column expressions: keys are constants, so their pads are literals."""

from __future__ import annotations

import hashlib
import hmac
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom.functions.scalar import let

# Block size and pads of HMAC, and the header of a token.
_BLOCK, _INNER, _OUTER = 64, 0x36, 0x5C
_HEADER = "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9"
#: Life of access and refresh tokens in seconds.
ACCESS_SECONDS, REFRESH_SECONDS = 15 * 60, 7 * 86400
CLAIMS = "userId STRING, sessionId STRING, tokenType STRING, iss STRING, aud STRING, sub STRING, iat BIGINT, exp BIGINT"


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Binary digest of a text or binary column."""
    short = hashlib.sha256(key).digest() if len(key) > _BLOCK else key
    pad = lambda x: F.lit(bytes(b ^ x for b in short.ljust(_BLOCK, b"\0")))
    inner = F.unhex(F.sha2(F.concat(pad(_INNER), message.cast("binary")), 256))
    return F.unhex(F.sha2(F.concat(pad(_OUTER), inner), 256))


def base64url(c: Column) -> Column:
    return F.translate(F.base64(c), "+/=\r\n", "-_")


def from_base64url(c: Column) -> Column:
    """Binary; null for what is no base64."""

    def decoded(x: Column) -> Column:
        ok = x.rlike(r"^[A-Za-z0-9_-]*\z") & (F.length(x) % 4 != 1)
        padded = F.rpad(F.translate(x, "-_", "+/"), (F.ceil(F.length(x) / 4) * 4).cast("int"), F.lit("="))
        return F.when(ok, F.unbase64(padded))

    return let(c, decoded)


def sign_token(claims: Column, key: bytes) -> Column:
    """A signed token of claims, given as JSON text."""
    body = F.concat(F.lit(_HEADER + "."), base64url(claims.cast("binary")))
    return let(body, lambda b: F.concat(b, F.lit("."), base64url(hmac_sha256(key, b))))


def token_claims(user: Column, session: Column, at: Column, issuer: str, audience: str | None = None, refresh: bool = False) -> Column:
    """The claims of an access or refresh token issued at ``at``, as JSON."""
    now = F.unix_seconds(at.cast("timestamp"))
    life = REFRESH_SECONDS if refresh else ACCESS_SECONDS
    parts = {"sessionId": session, "userId": user, "tokenType": F.lit("refresh") if refresh else None, "iat": now, "exp": now + life, "aud": F.lit(audience) if audience else None, "iss": F.lit(issuer), "sub": user}
    return F.to_json(F.struct(*[c.alias(n) for n, c in parts.items() if c is not None]))


def verify_token(token: Column, key: bytes, as_of: Column, issuer: str, audience: str | None = None, refresh: bool = False) -> Column:
    """The claims, or null for a token that isn't signed with the key, has ended, is another's, or is no refresh token where one is due."""


    def signed(part: Column) -> Column:
        """The middle part, if the last one is its signature; JSON is read only then."""
        head = F.from_json(from_base64url(F.get(part, F.lit(0))).cast("string"), "alg STRING")
        body = F.concat_ws(".", F.get(part, F.lit(0)), F.get(part, F.lit(1)))
        good = (F.size(part) == 3) & (F.get(part, F.lit(2)) == base64url(hmac_sha256(key, body)))
        usual = F.get(part, F.lit(0)) == _HEADER
        return F.when(F.coalesce(good & (usual | (head["alg"] == "HS256")), F.lit(False)), F.get(part, F.lit(1)))

    def live(claims: Column) -> Column:
        good = F.coalesce(claims["exp"] > F.unix_seconds(as_of.cast("timestamp")), F.lit(True)) & (claims["iss"] == issuer)
        if audience:
            good &= claims["aud"] == audience
        if refresh:
            good &= claims["tokenType"] == "refresh"
        return F.when(F.coalesce(good, F.lit(False)), claims)

    middle = let(F.split(token, r"\."), signed)
    return let(F.from_json(from_base64url(middle).cast("string"), CLAIMS), live)


def _uri(c: Column) -> Column:
    """Percent-encoded, slashes kept."""
    out = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def presigned_get(key: Column, bucket: str, region: str, access_key: str, secret: str, at: datetime, seconds: int = 900) -> Column:
    """A URL that reads one object of a bucket until ``seconds`` after ``at`` (UTC), signed by version 4 of the public scheme; null for no key."""
    day, stamp = at.strftime("%Y%m%d"), at.strftime("%Y%m%dT%H%M%SZ")
    host, scope = f"{bucket}.s3.amazonaws.com", f"{day}/{region}/s3/aws4_request"
    query = f"X-Amz-Algorithm=AWS4-HMAC-SHA256&X-Amz-Credential={access_key}%2F{scope.replace('/', '%2F')}&X-Amz-Date={stamp}&X-Amz-Expires={seconds}&X-Amz-SignedHeaders=host"
    signing = f"AWS4{secret}".encode()
    for step in (day, region, "s3", "aws4_request"):
        signing = hmac.new(signing, step.encode(), hashlib.sha256).digest()
    path = F.concat(F.lit("/"), _uri(key))
    request = F.concat(F.lit("GET\n"), path, F.lit(f"\n{query}\nhost:{host}\n\nhost\nUNSIGNED-PAYLOAD"))
    to_sign = F.concat(F.lit(f"AWS4-HMAC-SHA256\n{stamp}\n{scope}\n"), F.sha2(request, 256))
    signature = F.lower(F.hex(hmac_sha256(signing, to_sign)))
    return F.when(key != "", F.concat(F.lit(f"https://{host}"), path, F.lit(f"?{query}&X-Amz-Signature="), signature))
