"""Relationship edges between objects: owners, mounts, bindings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kubestrata.functions.scalars import blank
from kubestrata.schema import POD_REFS_DDL, VOLUME_DDL

_OWNERS = "metadata struct<name: string, ownerReferences: array<struct<kind: string, name: string, apiVersion: string>>>"


def owner_edges(objects: DataFrame) -> DataFrame:
    """child (resource, namespace, name) -> owner (kind, name), in reference order."""
    rows = objects.select("capture_id", "resource", "namespace", "name",
                          F.posexplode(F.from_json("obj", _OWNERS)["metadata"]["ownerReferences"]).alias("pos", "o"))
    return rows.select("capture_id", "resource", "namespace", "name", "pos", blank("o.kind").alias("owner_kind"),
                       blank("o.name").alias("owner_name"), blank("o.apiVersion").alias("owner_api_version"))


def _inner(arr: Column, member: str) -> Column:
    """The elements of a member array of all elements, one after the other."""
    return F.flatten(F.array_compact(arr[member]))


def mounts_of(pod: Column) -> Column:
    """array<struct<kind, targets>>: the names a parsed pod refers to, distinct: volumes, projections, env and envFrom.

    Member by member over whole arrays, which is compiled; only empty and missing names are filtered one by one.
    """
    spec = pod["spec"]
    volumes, sources = spec["volumes"], _inner(spec["volumes"]["projected"], "sources")
    env_from, env = ([_inner(spec[c], f) for c in ("containers", "initContainers")] for f in ("envFrom", "env"))
    none = F.array().cast("array<string>")

    def tagged(kind: str, *lists: Column) -> Column:
        names = F.filter(F.array_distinct(F.concat(*[F.coalesce(x, none) for x in lists])), lambda n: n != "")
        return F.struct(F.lit(kind).alias("kind"), names.alias("targets"))

    return F.array(
        tagged("configmap", volumes["configMap"]["name"], sources["configMap"]["name"], *[e["configMapRef"]["name"] for e in env_from],
               *[e["valueFrom"]["configMapKeyRef"]["name"] for e in env]),
        tagged("secret", volumes["secret"]["secretName"], sources["secret"]["name"], *[e["secretRef"]["name"] for e in env_from],
               *[e["valueFrom"]["secretKeyRef"]["name"] for e in env]),
        tagged("persistentvolumeclaim", volumes["persistentVolumeClaim"]["claimName"]),
    )


def mount_edges(pods: DataFrame) -> DataFrame:
    """pod -> configmap / secret / claim, distinct per pod row; no shuffle."""
    keys = ["capture_id", "namespace", "name"]
    # one-row generator: the parse is not repeated for each of the three kinds
    parsed = pods.select(*keys, F.explode(F.array(F.from_json("obj", POD_REFS_DDL))).alias("_p"))
    rows = parsed.select(*keys, F.inline(mounts_of(F.col("_p"))))
    return rows.select(*keys, "kind", F.explode("targets").alias("target"))


def used_by(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Reverse lookup: targets (capture_id, namespace, kind, target) with the pods that use them."""
    keys = ["capture_id", "namespace", "kind", "target"]
    return targets.select(*keys).distinct().join(edges, keys).select(*keys, F.col("name").alias("pod"))


def bindings(objects: DataFrame) -> DataFrame:
    """Claims with their bound volume (spec.volumeName) and volumes with their claim (spec.claimRef)."""
    o = objects.filter(F.col("resource").isin("persistentvolumeclaims", "persistentvolumes")).select(
        "capture_id", "resource", "namespace", "name", F.from_json("obj", VOLUME_DDL)["spec"].alias("s"))
    claim = o.filter("resource = 'persistentvolumeclaims'").select(
        "capture_id", "namespace", F.col("name").alias("claim"), blank("s.volumeName").alias("volume")).filter("volume <> ''")
    volume = o.filter("resource = 'persistentvolumes'").select(
        "capture_id", F.col("name").alias("volume"), blank("s.claimRef.namespace").alias("claim_ref_namespace"),
        blank("s.claimRef.name").alias("claim_ref")).filter("claim_ref <> ''")
    return claim.join(volume, ["capture_id", "volume"], "full_outer")


def owned_children(edges: DataFrame, owners: DataFrame, child: str = "pods") -> DataFrame:
    """Objects of kind ``child`` with any owner of that name in the namespace; matched by name only."""
    kids = edges.filter(F.col("resource") == child).select(
        "capture_id", "namespace", F.col("owner_name").alias("owner"), F.col("name").alias("child")).distinct()
    return owners.select("capture_id", "namespace", F.col("name").alias("owner")).distinct().join(
        kids, ["capture_id", "namespace", "owner"])


def deployment_pods(edges: DataFrame, deployments: DataFrame) -> DataFrame:
    """Two hops: deployment -> replica set -> pod."""
    sets = owned_children(edges, deployments, "replicasets").select(
        "capture_id", "namespace", F.col("owner").alias("deployment"), F.col("child").alias("name"))
    pods = owned_children(edges, sets, "pods").withColumnRenamed("owner", "replicaset").withColumnRenamed("child", "pod")
    return pods.join(sets.withColumnRenamed("name", "replicaset"), ["capture_id", "namespace", "replicaset"])


def relationships(objects: DataFrame, path: str, name: str) -> DataFrame:
    """All relations of one object: (title, kind, name), picked by its resource."""
    me = objects.filter((F.col("path") == path) & (F.col("name") == name))
    resource = path.rsplit("/", 1)[-1]
    out = owner_edges(me).select(F.lit("Owned by").alias("title"), F.col("owner_kind").alias("kind"), F.col("owner_name").alias("name"))
    near = objects.join(me.select("capture_id", "namespace").distinct(), ["capture_id", "namespace"], "left_semi")
    pods = near.filter("resource = 'pods'")
    titles = {"configmap": "Mounts ConfigMaps", "secret": "Mounts Secrets", "persistentvolumeclaim": "Mounts PVCs"}
    kinds = {"configmap": "ConfigMap", "secret": "Secret", "persistentvolumeclaim": "PersistentVolumeClaim"}
    lookup = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[F.col("kind")]
    if resource == "pods":
        out = out.unionByName(mount_edges(me).select(lookup(titles).alias("title"), lookup(kinds).alias("kind"), F.col("target").alias("name")))
    if resource in ("configmaps", "secrets", "persistentvolumeclaims"):
        hits = mount_edges(pods).filter((F.col("kind") == resource.removesuffix("s")) & (F.col("target") == name))
        out = out.unionByName(hits.select(F.lit("Used by pods").alias("title"), F.lit("Pod").alias("kind"), "name"))
    if resource == "persistentvolumeclaims":
        out = out.unionByName(bindings(me).select(F.lit("Bound volume").alias("title"), F.lit("PersistentVolume").alias("kind"), F.col("volume").alias("name")))
    if resource == "persistentvolumes":
        out = out.unionByName(bindings(me).select(F.lit("Bound claim").alias("title"), F.lit("PersistentVolumeClaim").alias("kind"), F.col("claim_ref").alias("name")))
    if resource in ("deployments", "replicasets", "statefulsets", "daemonsets", "jobs"):
        edges = owner_edges(near)
        kids = owned_children(edges, me, "pods").select(F.lit("Pods").alias("title"), F.lit("Pod").alias("kind"), F.col("child").alias("name"))
        out = out.unionByName(kids)
        if resource == "deployments":
            out = out.unionByName(owned_children(edges, me, "replicasets").select(
                F.lit("ReplicaSets").alias("title"), F.lit("ReplicaSet").alias("kind"), F.col("child").alias("name")))
    return out.orderBy("title", "name")
