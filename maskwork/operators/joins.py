"""Lookups against principals, grants, nonces and address ranges.

No join here is hinted to broadcast: Spark broadcasts a side whose measured size is below
its threshold and otherwise shuffles, splitting skewed partitions at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwork.functions.text import bound

KEY_PREFIX = "sk-gw-"
GRANT_TTL_US = 3_600_000_000
NONCE_TTL_US = 300_000_000


def resolve_principal(requests: DataFrame, principals: DataFrame, key: str, us: str) -> DataFrame:
    """Add the principal's columns and ``auth_status`` (ok, missing, not_virtual, unknown, expired).

    ``principals`` has key_hash, unique, and expiry_us (NULL means never).
    """
    k = F.coalesce(F.col(key), F.lit(""))
    hashed = requests.withColumn("key_hash", F.when(k.startswith(KEY_PREFIX), F.sha2(k, 256)))
    joined = hashed.join(principals.withColumn("__known", F.lit(True)), "key_hash", "left")
    status = (
        F.when(k == "", "missing")
        .when(~k.startswith(KEY_PREFIX), "not_virtual")
        .when(F.col("__known").isNull(), "unknown")
        .when(F.col(us) > F.col("expiry_us"), "expired")
        .otherwise("ok")
    )
    return joined.withColumn("auth_status", status).drop("__known", "key_hash")


def has_scope(scopes: Column, scope: str) -> Column:
    return F.coalesce(F.array_contains(scopes, scope), F.lit(False))


def with_optout(
    requests: DataFrame, grants: DataFrame, session: str, us: str, ttl_us: int = GRANT_TTL_US
) -> DataFrame:
    """Add ``opted_out``: some grant of the session lies within ``ttl_us`` before the request.

    Time is cut into buckets of the TTL.  A grant that counts lies in the request's bucket
    (then the earliest one there decides) or in the one before (then the latest one there
    does), so two numbers per session and bucket are enough and no pairs are built.
    """
    bucket = F.floor(F.col(us) / ttl_us).cast("bigint")
    per = grants.groupBy(F.col(session), bucket.alias("__b")).agg(F.min(us).alias("lo"), F.max(us).alias("hi"))
    null = F.lit(None).cast("bigint")
    same = per.select(session, "__b", F.col("lo").alias("__first"), null.alias("__last"))
    prev = per.select(session, (F.col("__b") + 1).alias("__b"), null.alias("__first"), F.col("hi").alias("__last"))
    sides = same.unionByName(prev).groupBy(session, "__b").agg(
        F.max("__first").alias("__first"), F.max("__last").alias("__last")
    )
    t = F.col(us)
    hit = (F.col("__first") <= t) | (F.col("__last") >= t - ttl_us)
    return (
        requests.withColumn("__b", bucket).join(sides, [session, "__b"], "left")
        .withColumn("opted_out", F.coalesce(hit, F.lit(False)))
        .drop("__b", "__first", "__last")
    )


def redeem_nonces(
    redemptions: DataFrame, issued: DataFrame, nonce: str, us: str, tie: str, ttl_us: int = NONCE_TTL_US
) -> DataFrame:
    """Add ``status`` (ok, unknown, expired, used) to each redemption.

    Only the first redemption at or after the issue uses up a nonce, whether or not it came
    in time.  The first one per nonce is an aggregate, so replays never meet in one sort.
    """
    known = issued.select(F.col(nonce), F.col(us).alias("__issued"))
    tried = redemptions.join(known, nonce, "left")
    after = tried.filter(F.col(us) >= F.col("__issued"))
    first = after.groupBy(nonce).agg(F.min(F.struct(F.col(us), F.col(tie))).alias("__first"))
    mine = F.struct(F.col(us), F.col(tie))
    status = (
        F.when(F.col("__issued").isNull() | (F.col(us) < F.col("__issued")), "unknown")
        .when(mine != F.col("__first"), "used")
        .when(F.col(us) - F.col("__issued") > ttl_us, "expired")
        .otherwise("ok")
    )
    return tried.join(first, nonce, "left").withColumn("status", status).drop("__issued", "__first")


# IPv4 ranges in order of precedence.
IPV4_RANGES = (
    ("link_local", "169.254.0.0", 16),
    ("multicast", "224.0.0.0", 4),
    ("unspecified", "0.0.0.0", 32),
    ("broadcast", "255.255.255.255", 32),
    ("loopback", "127.0.0.0", 8),
    ("private", "10.0.0.0", 8),
    ("private", "172.16.0.0", 12),
    ("private", "192.168.0.0", 16),
    ("private", "100.64.0.0", 10),
)
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
_GROUP = r"^[0-9a-f]{1,4}$"


def ipv4_number(ip: Column) -> Column:
    """Dotted quad -> number, NULL for anything else; octets have no leading zeros."""
    o = [F.regexp_extract(ip, _IPV4, i).try_cast("bigint") for i in range(1, 5)]
    return ((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3]


def ipv6_groups(ip: Column) -> Column:
    """The eight 16-bit groups of an IPv6 address, NULL for anything else.

    One ``::`` stands for one or more zero groups, and a dotted quad may stand for the last two.
    """

    def whole(low: Column) -> Column:
        tail = F.regexp_extract(low, r"([0-9.]*\.[0-9.]*)$", 1)
        return bound(F.struct(tail.alias("text"), ipv4_number(tail).alias("quad")), lambda t: bound(
            F.when(t["text"] == "", low).otherwise(F.concat(  # NULL if the quad is not valid
                F.substr(low, F.lit(1), F.length(low) - F.length(t["text"])),
                F.lower(F.hex(F.shiftright(t["quad"], 16))), F.lit(":"), F.lower(F.hex(t["quad"] % 65536)))),
            lambda plain: bound(F.split(plain, "::", -1), sides)))

    def groups(side: Column) -> Column:
        return F.when(side == "", F.array().cast("array<string>")).otherwise(F.split(side, ":", -1))

    def sides(s: Column) -> Column:
        right = groups(F.coalesce(F.try_element_at(s, F.lit(2)), F.lit("")))
        return bound(F.struct(groups(s[0]).alias("left"), right.alias("right"), F.size(s).alias("n")), lambda p: bound(
            F.lit(8) - F.size(p["left"]) - F.size(p["right"]), lambda missing: bound(
                F.when(
                    F.when(p["n"] == 1, missing == 0).otherwise((p["n"] == 2) & (missing >= 1)),
                    F.concat(p["left"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), p["right"])),
                lambda full: F.when(F.forall(full, lambda g: F.rlike(g, F.lit(_GROUP))),
                                    F.transform(full, lambda g: F.conv(g, 16, 10).cast("bigint"))))))

    return bound(F.lower(ip), whole)


def _ipv4_class(n: Column) -> Column:
    klass = None
    for name, base, bits in IPV4_RANGES:
        lo = sum(int(x) << s for x, s in zip(base.split("."), (24, 16, 8, 0)))
        cond = n.between(lo, lo + (1 << (32 - bits)) - 1)
        klass = F.when(cond, name) if klass is None else klass.when(cond, name)
    return klass.otherwise("public")


def _ipv6_class(g: Column) -> Column:
    def zero(count: int) -> Column:
        return F.forall(F.slice(g, 1, count), lambda x: x == 0)

    first = g[0]
    own = (
        F.when(first.between(0xFE80, 0xFEBF), "link_local")
        .when(first.between(0xFF00, 0xFFFF) & (first % 16 == 2), "link_local")
        .when(first.between(0xFF00, 0xFFFF), "multicast")
        .when(zero(8), "unspecified")
        .when(zero(7) & (g[7] == 1), "loopback")
        .when(first.between(0xFC00, 0xFDFF), "private")
        .otherwise("public")
    )
    mapped = bound(g[6] * 65536 + g[7], _ipv4_class)
    return F.when(zero(5) & (g[5] == 0xFFFF), mapped).otherwise(own)


def ip_class(ip: Column) -> Column:
    """link_local, multicast, unspecified, broadcast, loopback, private, public or invalid.

    The ranges are a handful of constants, so this is a CASE and not a range join. IPv6 addresses are
    expanded and compared as numbers; an IPv4 address mapped to IPv6 has the class of the IPv4 one.
    """

    def six(g: Column) -> Column:
        return F.when(g.isNotNull(), _ipv6_class(g)).otherwise("invalid")

    def four(text: Column) -> Column:
        return bound(ipv4_number(text), lambda n: F.when(n.isNotNull(), _ipv4_class(n)).otherwise(bound(ipv6_groups(text), six)))

    return bound(ip, four)


def egress_allowed(klass: Column, host_allowed: Column, allow_loopback: Column, allow_private: Column) -> Column:
    """Whether an address may be dialled; some classes are blocked whatever the policy."""
    return (
        F.when(klass.isin("invalid", "link_local", "multicast", "unspecified", "broadcast"), F.lit(False))
        .when(klass == "loopback", allow_loopback)
        .when(klass == "private", allow_private)
        .otherwise(host_allowed)
    )


def flag_known_hosts(df: DataFrame, hosts: DataFrame, host: str, out: str = "host_allowed") -> DataFrame:
    """Add whether the lower-cased host is on the list."""
    listed = hosts.select(F.lower("host").alias("__host")).distinct().withColumn("__hit", F.lit(True))
    low = df.withColumn("__host", F.lower(host))
    return low.join(listed, "__host", "left").withColumn(out, F.col("__hit").isNotNull()).drop("__host", "__hit")


def missing_references(principals: DataFrame, policies: DataFrame, ref: str, policy_id: str) -> DataFrame:
    """Principals whose routing policy does not exist; an empty reference is fine."""
    named = principals.filter(F.coalesce(F.col(ref), F.lit("")) != "")
    return named.join(policies.select(F.col(policy_id).alias(ref)), ref, "left_anti")
