"""Surface selection: boundary classes of files, seeds, what lies between sources and sinks, and what never meets an auth check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions.lineage import cut
from . import graph

# Boundary bits, and packages whose import marks a file.
SOURCE, SINK, AUTH, STORAGE = 2, 4, 8, 16
PACKAGES = {
    (".java", SOURCE): ("javax.servlet", "jakarta.servlet", "org.springframework.web", "javax.ws.rs", "jakarta.ws.rs", "io.javalin", "io.vertx.web", "io.micronaut.http", "io.quarkus.vertx.http", "ratpack.handling"),
    (".py", SOURCE): ("flask", "django.http", "django.views", "django.shortcuts", "fastapi", "aiohttp.web", "tornado.web", "starlette", "bottle", "falcon", "quart", "sanic", "litestar"),
    (".go", SOURCE): ('"net/http"', '"github.com/gin-gonic/gin"', '"github.com/labstack/echo"', '"github.com/gofiber/fiber"', '"github.com/gorilla/mux"', '"github.com/julienschmidt/httprouter"', '"github.com/go-chi/chi"', '"github.com/valyala/fasthttp"'),
    (".java", SINK): ("java.sql", "javax.sql", "jakarta.persistence", "org.springframework.data", "org.springframework.jdbc", "org.hibernate", "com.mongodb", "java.io.File", "java.nio.file", "java.lang.Runtime", "java.lang.ProcessBuilder", "org.springframework.ldap"),
    (".py", SINK): ("sqlite3", "psycopg2", "pymysql", "sqlalchemy", "django.db", "pymongo", "redis", "motor", "aiomysql", "subprocess", "paramiko", "fabric"),
    (".go", SINK): ('"database/sql"', '"gorm.io/gorm"', '"go.mongodb.org/mongo-driver"', '"github.com/jmoiron/sqlx"', '"os/exec"', '"github.com/go-redis/redis"', '"github.com/redis/go-redis"', '"os"', '"io/ioutil"', '"path/filepath"', '"archive/zip"'),
    (".java", AUTH): ("org.springframework.security", "javax.servlet.http.HttpSession", "jakarta.servlet.http.HttpSession", "io.jsonwebtoken", "org.keycloak", "com.auth0", "io.micronaut.security"),
    (".py", AUTH): ("flask_login", "flask_jwt", "flask_jwt_extended", "django.contrib.auth", "fastapi_users", "fastapi.security", "jose", "jwt", "authlib", "itsdangerous"),
    (".go", AUTH): ('"github.com/golang-jwt/jwt"', '"github.com/dgrijalva/jwt-go"', '"github.com/lestrrat-go/jwx"', '"golang.org/x/oauth2"', '"github.com/casbin/casbin"'),
    (".java", STORAGE): ("org.springframework.data", "org.hibernate", "javax.persistence", "jakarta.persistence", "redis.clients", "com.google.cloud.storage", "software.amazon.awssdk.services.s3"),
    (".py", STORAGE): ("sqlalchemy", "django.db", "pymongo", "motor", "redis", "aioredis", "boto3", "botocore"),
    (".go", STORAGE): ('"database/sql"', '"go.mongodb.org/mongo-driver"', '"github.com/go-redis/redis"', '"gorm.io/gorm"', '"github.com/jackc/pgx"', '"github.com/lib/pq"'),
}
IMPORT_LINES = 250
KIND_RANK = {"idor_candidate": 3, "auth_boundary": 2, "external_input": 1}


def boundary_bits(files: DataFrame, packages: dict[tuple[str, int], tuple[str, ...]] = PACKAGES) -> DataFrame:
    """A18, SRC02: files(path, text) with a boundary, as (path, bits): over the first lines, which kinds of packages occur.

    Prefixes hold no line feed, so looking at the head of the text at once is the same as line by line."""
    ext = X.extension(F.col("path"))

    def bits(head: Column) -> Column:
        out = F.lit(0)
        for (e, kind), names in packages.items():
            any_name = "|".join("\\Q" + n + "\\E" for n in names)
            out = out.bitwiseOR(F.when((ext == e) & head.rlike(any_name), F.lit(kind)).otherwise(F.lit(0)))
        return out

    # through a lambda, whose variable holds the head: as a column it would be cut off anew for every pattern
    found = F.get(F.transform(F.array(F.substring_index("text", "\n", IMPORT_LINES)), bits), F.lit(0))
    return files.select("path", found.alias("bits")).where("bits > 0")


def is_auth_method(name: Column, code: Column) -> Column:
    """G10."""
    return X.contains_any(F.lower(name), X.AUTH_WORDS) | X.contains_any(X.text(code), X.AUTH_ANNOTATIONS)


@dataclass(frozen=True)
class Reach:
    """What the searches find: methods with bits, the auth seeds, hops from sources and for each method the boundaries that it can reach."""

    methods: DataFrame
    auth: DataFrame
    forward: DataFrame
    masks: DataFrame


def reach(methods: DataFrame, calls: DataFrame, file_bits: DataFrame, ends: int = SINK | STORAGE) -> Reach:
    """One search forward from source files and one backward from auth seeds and the ends (sinks, storage) at once, over edges that are prepared once."""
    m = cut(methods.join(file_bits.select(F.col("path").alias("file"), "bits"), "file", "left").withColumn("bits", F.coalesce("bits", F.lit(0))))
    steps = graph.adjacency_lists(calls)
    has = lambda bit: F.col("bits").bitwiseAND(F.lit(bit)) > 0
    auth_files = m.where(has(AUTH))
    named = auth_files.where(is_auth_method(F.col("name"), F.col("code")))
    auth = (named if not named.isEmpty() else auth_files).select(F.col("node_id").alias("id")).distinct()
    forward = graph.depths(steps, m.where(has(SOURCE)).select(F.col("node_id").alias("id")))
    own = m.where(has(ends)).select(F.col("node_id").alias("id"), F.col("bits").bitwiseAND(F.lit(ends)).alias("mask"))
    masks = graph.masks(graph.reversed_lists(steps), own.unionByName(auth.withColumn("mask", F.lit(AUTH))))
    return Reach(m, auth, forward, masks)


def select_surfaces(methods: DataFrame, calls: DataFrame, file_bits: DataFrame, found: Reach | None = None) -> DataFrame:
    """methods(node_id, name, file, code) on a path from a source file to a sink file, auth seeds among them,
    as (surface_id, name, file, kind, depth).

    IDOR candidates are those that can't reach an auth seed and whose name or file says they handle a resource. By itself it searches for no storage.
    """
    r = found or reach(methods, calls, file_bits, SINK)
    to = lambda bit: F.col("mask").bitwiseAND(F.lit(bit)) > 0
    on_path = r.methods.join(r.forward.withColumnRenamed("id", "node_id"), "node_id").join(r.masks.where(to(SINK)).withColumnRenamed("id", "node_id"), "node_id")
    own = on_path.join(r.auth.select(F.col("id").alias("node_id"), F.lit(True).alias("is_auth")), "node_id", "left")
    signal = X.contains_any(F.lower("name"), X.IDOR_SIGNALS) | X.contains_any(F.lower("file"), X.IDOR_SIGNALS)
    kind = F.when(F.col("is_auth"), F.lit("auth_boundary")).when(~to(AUTH) & signal, F.lit("idor_candidate")).otherwise(F.lit("external_input"))
    return own.select(F.col("node_id").alias("surface_id"), "name", "file", kind.alias("kind"), "depth")


def second_order(methods: DataFrame, calls: DataFrame, file_bits: DataFrame, found: Reach | None = None) -> DataFrame:
    """Nodes that can reach both a storage file and a sink file, kind external_input, depth 0. By itself it searches backward from these only."""
    if found is None:
        near = methods.join(file_bits.select(F.col("path").alias("file"), "bits"), "file").select(F.col("node_id").alias("id"), F.col("bits").bitwiseAND(F.lit(SINK | STORAGE)).alias("mask"))
        masks = graph.masks(graph.reversed_edges(calls), near.where("mask != 0"))
    else:
        masks = found.masks
    both = masks.where(F.col("mask").bitwiseAND(F.lit(STORAGE | SINK)) == STORAGE | SINK).select("id")
    return both.join(methods.withColumnRenamed("node_id", "id"), "id", "left").select(F.col("id").alias("surface_id"), X.text(F.col("name")).alias("name"), X.text(F.col("file")).alias("file"), F.lit("external_input").alias("kind"), F.lit(0).alias("depth"))


def all_surfaces(methods: DataFrame, calls: DataFrame, file_bits: DataFrame) -> DataFrame:
    """Second-order ones only where absent; by kind, depth and id."""
    found = reach(methods, calls, file_bits)
    first = select_surfaces(methods, calls, file_bits, found)
    more = second_order(methods, calls, file_bits, found).join(first.select("surface_id"), "surface_id", "left_anti")
    rank = X.choose([(F.col("kind") == k, F.lit(v)) for k, v in KIND_RANK.items()], F.lit(0))
    return first.unionByName(more.select(*first.columns)).orderBy(rank.desc(), "depth", "surface_id")
