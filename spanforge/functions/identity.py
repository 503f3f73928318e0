"""Identity of a caller from headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.functions.tokens import fingerprint

#: Cookies that hold a session.
SESSION_COOKIES = ("sessionid", "session", "jsessionid", "phpsessid", "sid", "auth_session", "asid", "connect.sid")


def jwt_payload(token: Column) -> Column:
    """The claims of a JSON web token as text, unverified; null if it is none."""
    body = F.regexp_extract(token, r"^[^.]*\.([A-Za-z0-9_=-]+)", 1)
    std = F.translate(body, "-_", "+/")
    padded = F.concat(F.rtrim(std, F.lit("=")), F.when(F.length(F.rtrim(std, F.lit("="))) % 4 == 2, "==").when(F.length(F.rtrim(std, F.lit("="))) % 4 == 3, "=").otherwise(""))
    text = F.try_to_binary(F.when(body != "", padded), F.lit("base64")).cast("string")
    return F.when(F.json_object_keys(text).isNotNull(), text)


def first_claim(claims: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.get_json_object(claims, f"$.{n}") for n in names))


def role_text(claims: Column) -> Column:
    """A role as text, a list of roles joined by commas."""
    r = first_claim(claims, ("role", "roles", "scope", "groups"))
    return F.when(r.startswith("["), F.array_join(F.from_json(r, "array<string>"), ",")).otherwise(r)


def cookie_session(cookie: Column, key_hex: str) -> Column:
    pairs = F.transform(F.split(cookie, ";"), lambda p: F.struct(F.lower(F.btrim(F.substring_index(p, "=", 1))).alias("k"), F.btrim(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("v"), (F.instr(p, "=") > 0).alias("ok")))
    hit = F.get(F.filter(pairs, lambda p: p["ok"] & p["k"].isin(*SESSION_COOKIES) & (p["v"] != "")), 0)
    return F.when(hit.isNotNull(), F.concat(F.lit("sid-"), fingerprint(hit["v"], key_hex)))


def identity(headers: Column, key_hex: str) -> Column:
    """user_id, user_role, session_id, auth_session_id with literal defaults."""
    auth = headers["authorization"]
    token = F.when(auth.rlike("^(Bearer|bearer|Token) "), F.btrim(F.substring_index(auth, " ", -1)))
    claims = jwt_payload(token)
    header = lambda *names: F.coalesce(*(F.nullif(headers[n], F.lit("")) for n in names))
    user = F.nullif(first_claim(claims, ("sub", "user_id", "uid", "userId", "email")), F.lit(""))
    return F.struct(
        F.coalesce(user, header("x-user-id", "x-userid", "x-uid", "user-id"), F.lit("unknown")).alias("user_id"),
        F.coalesce(F.nullif(role_text(claims), F.lit("")), header("x-user-role", "x-role", "x-roles"), F.lit("unknown")).alias("user_role"),
        F.coalesce(cookie_session(headers["cookie"], key_hex), F.lit("sid-0")).alias("session_id"),
        F.coalesce(F.nullif(F.get_json_object(claims, "$.jti"), F.lit("")), F.lit("0")).alias("auth_session_id"),
    )
