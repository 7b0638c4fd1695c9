"""Envelope schemas, per-kind payload schemas and fixed value tables."""

from __future__ import annotations

# ---------------------------------------------------------------- envelopes

RECORD_DDL = (
    "capture_id STRING, path STRING, seq BIGINT, captured_at TIMESTAMP_NTZ, event_type STRING, "
    "http_method STRING, response_code INT, body STRING"
)
# one line of the record stream; response_body stays raw text
NDJSON_DDL = (
    "id STRING, captured_at STRING, api_path STRING, event_type STRING, http_method STRING, "
    "response_code INT, response_body STRING"
)
CAPTURE_DDL = (
    "capture_id STRING, captured_at TIMESTAMP_NTZ, captured_until TIMESTAMP_NTZ, kubernetes_version STRING, "
    "server_address STRING, record_count BIGINT, deduplicated_count BIGINT, auto_discovered BOOLEAN, "
    "watch_enabled BOOLEAN, intervals ARRAY<STRING>, uncompressed_bytes BIGINT, redacted BOOLEAN, "
    "secrets_redacted BIGINT, fields_redacted BIGINT, format_version INT"
)
CURRENT_FORMAT_VERSION = 2

LIST_DDL = "apiVersion STRING, kind STRING, metadata STRING, items ARRAY<STRING>"
TABLE_DDL = "apiVersion STRING, kind STRING, metadata STRING, columnDefinitions STRING, rows ARRAY<STRING>"
META_DDL = "metadata STRUCT<name: STRING, namespace: STRING, uid: STRING, labels: MAP<STRING, STRING>>"
ROW_DDL = "object STRUCT<metadata: STRUCT<name: STRING, namespace: STRING, uid: STRING, labels: MAP<STRING, STRING>>>"

# ----------------------------------------------------- payloads (per kind)

_META = (
    "metadata STRUCT<name: STRING, namespace: STRING, uid: STRING, resourceVersion: STRING, "
    "creationTimestamp: STRING, deletionTimestamp: STRING, labels: MAP<STRING, STRING>, "
    "annotations: MAP<STRING, STRING>, "
    "ownerReferences: ARRAY<STRUCT<kind: STRING, name: STRING, apiVersion: STRING>>>"
)
_STATE = (
    "STRUCT<running: STRUCT<startedAt: STRING>, waiting: STRUCT<reason: STRING, message: STRING>, "
    "terminated: STRUCT<reason: STRING, message: STRING, exitCode: INT>>"
)
_CONTAINER_STATUS = (
    f"STRUCT<name: STRING, image: STRING, ready: BOOLEAN, restartCount: INT, state: {_STATE}, lastState: {_STATE}>"
)
_PROBE = (
    "STRUCT<httpGet: STRUCT<path: STRING, port: STRING, scheme: STRING>, tcpSocket: STRUCT<port: STRING>, "
    "exec: STRUCT<command: ARRAY<STRING>>>"
)
_CONTAINER = (
    "STRUCT<name: STRING, image: STRING, "
    "ports: ARRAY<STRUCT<name: STRING, containerPort: INT, protocol: STRING>>, "
    "resources: STRUCT<requests: MAP<STRING, STRING>, limits: MAP<STRING, STRING>>, "
    f"livenessProbe: {_PROBE}, readinessProbe: {_PROBE}, startupProbe: {_PROBE}, "
    "envFrom: ARRAY<STRUCT<configMapRef: STRUCT<name: STRING>, secretRef: STRUCT<name: STRING>>>, "
    "env: ARRAY<STRUCT<name: STRING, valueFrom: STRUCT<configMapKeyRef: STRUCT<name: STRING>, "
    "secretKeyRef: STRUCT<name: STRING>>>>>"
)
_VOLUME = (
    "STRUCT<name: STRING, configMap: STRUCT<name: STRING>, secret: STRUCT<secretName: STRING>, "
    "persistentVolumeClaim: STRUCT<claimName: STRING>, "
    "projected: STRUCT<sources: ARRAY<STRUCT<configMap: STRUCT<name: STRING>, secret: STRUCT<name: STRING>>>>>"
)
_CONDITION = "STRUCT<type: STRING, status: STRING, reason: STRING, message: STRING>"
_TEMPLATE = (
    "STRUCT<spec: STRUCT<nodeSelector: MAP<STRING, STRING>, "
    "containers: ARRAY<STRUCT<name: STRING, image: STRING>>>>"
)

POD_DDL = (
    f"{_META}, spec STRUCT<nodeName: STRING, restartPolicy: STRING, readinessGates: ARRAY<STRING>, "
    f"containers: ARRAY<{_CONTAINER}>, initContainers: ARRAY<{_CONTAINER}>, volumes: ARRAY<{_VOLUME}>>, "
    "status STRUCT<phase: STRING, reason: STRING, podIP: STRING, qosClass: STRING, nominatedNodeName: STRING, "
    f"conditions: ARRAY<{_CONDITION}>, containerStatuses: ARRAY<{_CONTAINER_STATUS}>, "
    f"initContainerStatuses: ARRAY<{_CONTAINER_STATUS}>>"
)
# Narrow pod schemas: a row is decoded only as far as its consumer reads.
_OWNED = "metadata STRUCT<name: STRING, ownerReferences: ARRAY<STRUCT<kind: STRING, name: STRING>>"
_STATUSES = f"containerStatuses: ARRAY<{_CONTAINER_STATUS}>, initContainerStatuses: ARRAY<{_CONTAINER_STATUS}>"
# The decoder pays for each member of a schema at each object, so a summary of the statuses has no more than it reads.
_ENDS = (
    "ARRAY<STRUCT<ready: BOOLEAN, restartCount: INT, state: STRUCT<running: STRUCT<startedAt: STRING>, "
    "waiting: STRUCT<reason: STRING>, terminated: STRUCT<reason: STRING, exitCode: INT>>>>"
)
_SUMMED = f"containerStatuses: {_ENDS}, initContainerStatuses: {_ENDS}"
_FIRST_OWNER = "metadata STRUCT<name: STRING, ownerReferences: ARRAY<STRUCT<name: STRING>>>"
_RESOURCES = (
    "spec STRUCT<containers: ARRAY<STRUCT<resources: STRUCT<requests: MAP<STRING, STRING>, limits: MAP<STRING, STRING>>>>>"
)
POD_HEALTH_DDL = f"{_FIRST_OWNER}, status STRUCT<phase: STRING, {_SUMMED}>"
POD_ROWS_DDL = f"metadata STRUCT<creationTimestamp: STRING, labels: MAP<STRING, STRING>>, status STRUCT<phase: STRING, {_SUMMED}>"
POD_HEADLINE_DDL = (
    "metadata STRUCT<creationTimestamp: STRING>, spec STRUCT<nodeName: STRING>, "
    f"status STRUCT<phase: STRING, podIP: STRING, qosClass: STRING, {_SUMMED}>"
)
POD_RESOURCES_DDL = f"{_FIRST_OWNER}, {_RESOURCES}"
POD_STATUS_DDL = f"status STRUCT<phase: STRING, {_STATUSES}>"
POD_RULES_DDL = f"{_FIRST_OWNER}, {_RESOURCES}, status STRUCT<phase: STRING, conditions: ARRAY<{_CONDITION}>, {_SUMMED}>"
_REFS = (
    "ARRAY<STRUCT<envFrom: ARRAY<STRUCT<configMapRef: STRUCT<name: STRING>, secretRef: STRUCT<name: STRING>>>, "
    "env: ARRAY<STRUCT<valueFrom: STRUCT<configMapKeyRef: STRUCT<name: STRING>, secretKeyRef: STRUCT<name: STRING>>>>>>"
)
POD_MOUNTS_DDL = f"{_OWNED}>, spec STRUCT<volumes: ARRAY<{_VOLUME}>, containers: {_REFS}, initContainers: {_REFS}>"
POD_REFS_DDL = (
    "spec STRUCT<volumes: ARRAY<STRUCT<configMap: STRUCT<name: STRING>, secret: STRUCT<secretName: STRING>, "
    "persistentVolumeClaim: STRUCT<claimName: STRING>, "
    "projected: STRUCT<sources: ARRAY<STRUCT<configMap: STRUCT<name: STRING>, secret: STRUCT<name: STRING>>>>>>, "
    f"containers: {_REFS}, initContainers: {_REFS}>"
)
POD_NAMES_DDL = "spec STRUCT<containers: ARRAY<STRUCT<name: STRING>>, initContainers: ARRAY<STRUCT<name: STRING>>>"
POD_VIEW_DDL = (
    "metadata STRUCT<name: STRING, creationTimestamp: STRING, deletionTimestamp: STRING>, "
    "spec STRUCT<nodeName: STRING, readinessGates: ARRAY<STRING>, containers: ARRAY<STRUCT<name: STRING>>>, "
    "status STRUCT<phase: STRING, reason: STRING, podIP: STRING, nominatedNodeName: STRING, "
    "containerStatuses: ARRAY<STRUCT<ready: BOOLEAN, restartCount: INT, state: STRUCT<waiting: STRUCT<reason: STRING>, "
    "terminated: STRUCT<reason: STRING>>>>>"
)
POD_META_DDL = (
    "metadata STRUCT<creationTimestamp: STRING, labels: MAP<STRING, STRING>, annotations: MAP<STRING, STRING>>, "
    f"status STRUCT<conditions: ARRAY<{_CONDITION}>>"
)
_CARD = (
    "ARRAY<STRUCT<name: STRING, image: STRING, ports: ARRAY<STRUCT<name: STRING, containerPort: INT, protocol: STRING>>, "
    "resources: STRUCT<requests: MAP<STRING, STRING>, limits: MAP<STRING, STRING>>, "
    f"livenessProbe: {_PROBE}, readinessProbe: {_PROBE}, startupProbe: {_PROBE}>>"
)
POD_CARDS_DDL = f"spec STRUCT<containers: {_CARD}, initContainers: {_CARD}>, status STRUCT<phase: STRING, {_STATUSES}>"
# spec.selector stays text: it is a flat map for some kinds and a structured selector for others
WORKLOAD_DDL = (
    f"{_META}, spec STRUCT<replicas: BIGINT, selector: STRING, completions: BIGINT, suspend: BOOLEAN, "
    f"schedule: STRING, template: {_TEMPLATE}, jobTemplate: STRUCT<spec: STRUCT<template: {_TEMPLATE}>>>, "
    "status STRUCT<replicas: BIGINT, readyReplicas: BIGINT, availableReplicas: BIGINT, updatedReplicas: BIGINT, "
    "numberReady: BIGINT, desiredNumberScheduled: BIGINT, currentNumberScheduled: BIGINT, "
    "updatedNumberScheduled: BIGINT, numberAvailable: BIGINT, succeeded: BIGINT, failed: BIGINT, "
    f"active: STRING, lastScheduleTime: STRING, conditions: ARRAY<{_CONDITION}>>"
)
NODE_DDL = (
    f"{_META}, spec STRUCT<unschedulable: BOOLEAN>, status STRUCT<conditions: ARRAY<{_CONDITION}>, "
    "addresses: ARRAY<STRUCT<type: STRING, address: STRING>>, nodeInfo: STRUCT<kubeletVersion: STRING, "
    "osImage: STRING, kernelVersion: STRING, containerRuntimeVersion: STRING>>"
)
VOLUME_DDL = (
    f"{_META}, spec STRUCT<storageClassName: STRING, volumeName: STRING, accessModes: ARRAY<STRING>, "
    "capacity: STRUCT<storage: STRING>, persistentVolumeReclaimPolicy: STRING, "
    "claimRef: STRUCT<namespace: STRING, name: STRING>>, "
    "status STRUCT<phase: STRING, capacity: STRUCT<storage: STRING>, accessModes: ARRAY<STRING>>"
)
_INGRESS_POINT = "ARRAY<STRUCT<ip: STRING, hostname: STRING>>"
SERVICE_DDL = (
    f"{_META}, spec STRUCT<type: STRING, clusterIP: STRING, externalName: STRING, externalIPs: ARRAY<STRING>, "
    "ports: ARRAY<STRUCT<port: BIGINT, nodePort: BIGINT, protocol: STRING>>, selector: MAP<STRING, STRING>, "
    "ingressClassName: STRING, rules: ARRAY<STRUCT<host: STRING>>, tls: ARRAY<STRING>>, "
    f"status STRUCT<loadBalancer: STRUCT<ingress: {_INGRESS_POINT}>>"
)
ENDPOINTS_DDL = (
    f"{_META}, subsets ARRAY<STRUCT<addresses: ARRAY<STRUCT<ip: STRING>>, ports: ARRAY<STRUCT<port: BIGINT>>>>"
)
CONFIG_DDL = (
    f"{_META}, type STRING, data MAP<STRING, STRING>, stringData MAP<STRING, STRING>, "
    "binaryData MAP<STRING, STRING>, secrets ARRAY<STRING>, status STRUCT<phase: STRING, printableStatus: STRING>"
)
_INVOLVED = "STRUCT<kind: STRING, namespace: STRING, name: STRING, uid: STRING>"
EVENT_DDL = (
    f"{_META}, type STRING, reason STRING, message STRING, note STRING, count INT, firstTimestamp STRING, "
    "lastTimestamp STRING, eventTime STRING, reportingController STRING, source STRUCT<component: STRING>, "
    f"involvedObject {_INVOLVED}, regarding {_INVOLVED}"
)
CRD_DDL = (
    "spec STRUCT<group: STRING, scope: STRING, version: STRING, names: STRUCT<kind: STRING, plural: STRING, "
    "singular: STRING, shortNames: ARRAY<STRING>>, versions: ARRAY<STRUCT<name: STRING, served: BOOLEAN, "
    "additionalPrinterColumns: ARRAY<STRUCT<name: STRING, type: STRING, jsonPath: STRING, priority: INT, "
    "description: STRING>>>>>"
)

# ------------------------------------------------------------ fixed values

# Kinds whose plural resource name is known; the plural follows from the kind (see plural_of).
KNOWN_KINDS = """
Binding ComponentStatus ConfigMap Endpoints Event LimitRange Namespace Node PersistentVolume
PersistentVolumeClaim Pod PodTemplate ReplicationController ResourceQuota Secret Service ServiceAccount
ControllerRevision DaemonSet Deployment ReplicaSet StatefulSet
CronJob Job HorizontalPodAutoscaler Scale
Ingress IngressClass NetworkPolicy IPAddress ServiceCIDR
PodDisruptionBudget Eviction
ClusterRole ClusterRoleBinding Role RoleBinding
CSIDriver CSINode CSIStorageCapacity StorageClass VolumeAttachment VolumeAttributesClass
PriorityClass RuntimeClass Lease LeaseCandidate CertificateSigningRequest ClusterTrustBundle EndpointSlice
FlowSchema PriorityLevelConfiguration
MutatingWebhookConfiguration ValidatingWebhookConfiguration ValidatingAdmissionPolicy
ValidatingAdmissionPolicyBinding MutatingAdmissionPolicy MutatingAdmissionPolicyBinding
TokenReview SelfSubjectReview TokenRequest SubjectAccessReview SelfSubjectAccessReview
LocalSubjectAccessReview SelfSubjectRulesReview
DeviceClass ResourceClaim ResourceClaimTemplate ResourceSlice StorageVersion StorageVersionMigration
CustomResourceDefinition APIService
""".split()


def plural_of(kind: str) -> str:
    low = kind.lower()
    if low == "endpoints":
        return low
    if low.endswith("s"):
        return low + "es"
    if low.endswith("y"):
        return low[:-1] + "ies"
    return low + "s"


KIND_BY_RESOURCE = {plural_of(k): k for k in KNOWN_KINDS}

# Short names used when discovery gives none.
SHORT_NAMES = {
    "pods": "po", "services": "svc", "deployments": "deploy", "daemonsets": "ds", "namespaces": "ns",
    "nodes": "no", "configmaps": "cm", "persistentvolumeclaims": "pvc", "persistentvolumes": "pv",
    "serviceaccounts": "sa", "replicasets": "rs", "statefulsets": "sts", "jobs": "job", "cronjobs": "cj",
    "ingresses": "ing", "horizontalpodautoscalers": "hpa", "replicationcontrollers": "rc",
    "resourcequotas": "quota", "limitranges": "limits", "events": "ev", "endpoints": "ep",
    "networkpolicies": "netpol", "poddisruptionbudgets": "pdb", "clusterrolebindings": "crb",
    "clusterroles": "cr", "rolebindings": "rb", "storageclasses": "sc", "customresourcedefinitions": "crd",
}

# Groups left out of automatic target expansion.
EXCLUDED_GROUPS = ["metrics.k8s.io", "apiregistration.k8s.io", "authentication.k8s.io", "authorization.k8s.io"]

# API groups served by the control plane itself.
NATIVE_GROUPS = [
    "", "apps", "batch", "autoscaling", "networking.k8s.io", "policy", "rbac.authorization.k8s.io",
    "storage.k8s.io", "scheduling.k8s.io", "node.k8s.io", "coordination.k8s.io", "certificates.k8s.io",
    "discovery.k8s.io", "events.k8s.io", "admissionregistration.k8s.io", "apiextensions.k8s.io",
    "apiregistration.k8s.io", "authentication.k8s.io", "authorization.k8s.io", "flowcontrol.apiserver.k8s.io",
]

# Kinds that never live in a namespace.
CLUSTER_SCOPED = [
    "nodes", "namespaces", "persistentvolumes", "storageclasses", "clusterroles", "clusterrolebindings",
    "customresourcedefinitions", "apiservices", "ingressclasses", "priorityclasses", "runtimeclasses",
    "volumeattachments", "csidrivers", "csinodes", "mutatingwebhookconfigurations",
    "validatingwebhookconfigurations", "validatingadmissionpolicies", "validatingadmissionpolicybindings",
    "certificatesigningrequests", "flowschemas", "prioritylevelconfigurations",
]

WORKLOADS = ["deployments", "statefulsets", "daemonsets", "jobs", "replicasets"]
VIRTUAL_MACHINES = ["virtualmachines", "virtualmachineinstances"]
PREFERRED_TILES = [
    "deployments", "pods", "services", "configmaps", "secrets", "persistentvolumeclaims",
    "customresourcedefinitions", "virtualmachines",
]

# Field selectors: per (group, resource) the accepted labels, their aliases, and where a value is read.
# A value is "json.path", or ("json.path", default when absent), or ("json.path", default, fallback path).
_INVOLVED_FIELDS = ["kind", "namespace", "name", "uid", "apiVersion", "resourceVersion", "fieldPath"]
FIELD_LABELS = {
    ("", "pods"): {
        "namespaced": True,
        "accepted": ["spec.nodeName", "spec.restartPolicy", "spec.schedulerName", "spec.serviceAccountName",
                     "spec.hostNetwork", "status.phase", "status.podIP", "status.podIPs",
                     "status.nominatedNodeName"],
        "aliases": {"spec.host": "spec.nodeName"},
        "values": {"spec.hostNetwork": ("spec.hostNetwork", "false")},
        "unreadable": ["status.podIPs"],
    },
    ("", "nodes"): {"accepted": ["spec.unschedulable"],
                    "values": {"spec.unschedulable": ("spec.unschedulable", "false")}},
    ("", "namespaces"): {"accepted": ["status.phase"]},
    ("", "secrets"): {"namespaced": True, "accepted": ["type"]},
    ("", "services"): {"namespaced": True, "accepted": ["spec.clusterIP", "spec.type"]},
    ("", "replicationcontrollers"): {"namespaced": True, "accepted": ["status.replicas"],
                                     "values": {"status.replicas": ("status.replicas", "0")}},
    ("", "events"): {
        "namespaced": True,
        "accepted": [f"involvedObject.{f}" for f in _INVOLVED_FIELDS]
        + ["reason", "reportingComponent", "source", "type"],
        "values": {"source": ("source.component", "", "reportingComponent")},
    },
    ("events.k8s.io", "events"): {
        "namespaced": True,
        "accepted": ["reason", "type"],
        "aliases": {**{f"regarding.{f}": f"involvedObject.{f}" for f in _INVOLVED_FIELDS},
                    "reportingController": "reportingComponent"},
        "values": {**{f"involvedObject.{f}": (f"regarding.{f}", "") for f in _INVOLVED_FIELDS},
                   "reportingComponent": ("reportingController", "")},
    },
    ("batch", "jobs"): {"namespaced": True, "accepted": ["status.successful"],
                        "values": {"status.successful": ("status.succeeded", "0")}},
    ("certificates.k8s.io", "certificatesigningrequests"): {"accepted": ["spec.signerName"]},
}

# Pod reasons: reason(s) -> (rule id, severity, title, suggestion).
REASON_RULES = [
    (["CrashLoopBackOff"], "pod.crashloopbackoff", "critical", "CrashLoopBackOff",
     "It starts and dies again and again: read the last run's log and how it ended."),
    (["OOMKilled"], "pod.oomkilled", "critical", "OOMKilled",
     "Killed for using more memory than allowed: give it more, or find out what it keeps."),
    (["ImagePullBackOff", "ErrImagePull", "InvalidImageName"], "pod.image-pull", "critical", "Image pull failure",
     "The image cannot be fetched: is its name right, and may this pod read the registry?"),
    (["CreateContainerConfigError", "CreateContainerError"], "pod.config-error", "critical",
     "Container config error", "Something the container's settings point to does not exist yet."),
    (["Error"], "pod.container-error", "warning", "Container terminated with error",
     "It ended with a failure code: its log should say why."),
    (["Failed"], "pod.failed", "warning", "Pod in Failed phase",
     "All its work is over and some of it failed: see its events."),
    (["Unknown"], "pod.unknown", "warning", "Pod in Unknown phase",
     "Nobody has heard of it lately: look at the machine it runs on."),
]
OTHER_REASON_SUGGESTION = "See the pod itself for more about this."
BENIGN_REASONS = ["ContainerCreating", "PodInitializing", "Completed", ""]

# Rules on other objects: rule id -> (severity, category, suggestion).
OBJECT_RULES = {
    "scheduling.unschedulable": ("warning", "scheduling", "No machine takes it: ask for less, allow more machines, "
                                 "or add one."),
    "storage.pvc-unbound": ("warning", "storage", "No volume serves this claim: is its class known, and who would "
                            "make the volume?"),
    "cluster.version-skew": ("warning", "cluster", "Upgrade the older side until they are two minor versions apart "
                             "at most."),
    "workload.no-requests": ("warning", "workload", "Say how much CPU and memory it needs, so that it is placed "
                             "where there is room."),
    "workload.no-limits": ("info", "workload", "Say how much it may use at most, so that it cannot starve others."),
    "node.not-ready": ("critical", "node", "The machine does not answer as it should: is its agent up and reachable?"),
    "node.pressure": ("warning", "node", "The machine runs short: move work away before it is thrown out."),
    "cluster.deprecated-api": ("warning", "cluster", "Use the version of this API that will stay."),
}
REPLICA_SUGGESTION = "Some of its pods are not up: their own findings say why."
DAEMON_SUGGESTION = "Its pods are not up on every machine: compare with the machines' own findings."

DEPRECATED_APIS = {
    "extensions/v1beta1": "removed in v1.22",
    "apps/v1beta1": "removed in v1.16",
    "apps/v1beta2": "removed in v1.16",
    "networking.k8s.io/v1beta1": "removed in v1.22",
    "rbac.authorization.k8s.io/v1beta1": "removed in v1.22",
    "policy/v1beta1": "removed in v1.25 (PodSecurityPolicy) / moved",
    "batch/v1beta1": "removed in v1.25 (CronJob)",
    "autoscaling/v2beta1": "removed in v1.25",
    "autoscaling/v2beta2": "removed in v1.26",
    "storage.k8s.io/v1beta1": "deprecated; use storage.k8s.io/v1",
}

# Which reason names a pod when it has several, most telling first.
ISSUE_PRIORITY = [
    "CrashLoopBackOff", "OOMKilled", "ImagePullBackOff", "ErrImagePull", "CreateContainerError",
    "CreateContainerConfigError", "InvalidImageName", "Error", "Failed", "Unknown",
]
BAD_ISSUES = [r for r in ISSUE_PRIORITY if r != "Unknown"]
BAD_EVENT_REASONS = [
    "BackOff", "Killing", "Killed", "Failed", "FailedScheduling", "FailedMount", "FailedCreate", "OOMKilled",
    "Evicted",
]
BAD_WAITING_REASONS = [
    "CrashLoopBackOff", "ImagePullBackOff", "ErrImagePull", "CreateContainerError", "CreateContainerConfigError",
]
SIDECAR_HINTS = ["istio-proxy", "linkerd-proxy", "sidecar", "envoy", "fluent", "vector", "log-router"]
ACCESS_MODES = {"ReadWriteOnce": "RWO", "ReadOnlyMany": "ROX", "ReadWriteMany": "RWX", "ReadWriteOncePod": "RWOP"}

# Value types of common fields, used by typed redaction when a rule names none.
FIELD_TYPES = {
    "Pod": POD_DDL, "Deployment": WORKLOAD_DDL, "DaemonSet": WORKLOAD_DDL, "StatefulSet": WORKLOAD_DDL,
    "ReplicaSet": WORKLOAD_DDL, "Job": WORKLOAD_DDL, "CronJob": WORKLOAD_DDL, "ConfigMap": CONFIG_DDL,
    "Secret": CONFIG_DDL, "Service": SERVICE_DDL, "Namespace": CONFIG_DDL, "Node": NODE_DDL,
    "PersistentVolume": VOLUME_DDL, "PersistentVolumeClaim": VOLUME_DDL,
}
