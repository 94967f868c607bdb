"""Plain-language context of findings, joined as a small table."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What reports say for each detector.
DEFAULT = (None, None, "This mod exhibits a flagged capability.", "Review this finding manually.")
RULE = (None, None, "This mod matched a known threat-intelligence signature.", "This matches a documented pattern from known malicious mods.")
CONTEXT = {
    "d01": ("T1059", "Command and Scripting Interpreter", "This mod can run operating-system commands on your computer.", "Do not run this mod unless you trust its source completely."),
    "d02": ("T1071", "Application Layer Protocol", "This mod can send or receive data over the network.", "Check whether the destination is a service you recognize and expect."),
    "d03": ("T1129", "Shared Modules", "This mod can load additional code at runtime, potentially from outside the mod file itself.", "Verify what code this mod loads and from where before trusting it."),
    "d04": (None, None, "This mod can read or write files on your computer, including other mod files.", "Review why this mod needs file access beyond its own configuration."),
    "d05": ("T1547", "Boot or Logon Autostart Execution", "This mod can configure your computer to run something automatically at startup, outside of Minecraft.", "This capability has no legitimate use in a Minecraft mod — treat as malicious."),
    "d06": ("T1055", "Process Injection", "This mod deserializes data in a way that can execute arbitrary code if the data is attacker-controlled.", "Verify the source of any data this mod deserializes."),
    "d07": ("T1129", "Shared Modules", "This mod loads a native (non-Java) library, which runs with fewer safety guarantees than Java code.", "Native libraries are rare in ordinary mods outside of rendering/audio (LWJGL) — verify the source."),
    "d08": ("T1528", "Steal Application Access Token", "This mod can access your Minecraft session token, Discord token, or saved browser credentials.", "Treat as credential theft unless you can verify exactly why this mod needs this access."),
    "d09": ("T1027", "Obfuscated Files or Information", "Parts of this mod's code are deliberately hidden or obscured.", "Legitimate mods rarely need to hide their own code — treat as suspicious."),
    "d10": ("T1055", "Process Injection", "This mod calls methods indirectly in a way that can bypass simple code scanning.", "Combined with other findings, this often indicates deliberate evasion."),
    "d11": ("T1102", "Web Service", "This mod may receive remote commands via a public blockchain, which cannot be taken down or blocked like a normal server.", "This is a known command-and-control technique — treat as malicious."),
    "d12": (None, None, "A resource/datapack file in this mod contains unusual or oversized content.", "Review the specific file flagged before installing."),
    "d13": ("T1055", "Process Injection", "This mod rewrites part of Minecraft's own code (or another mod's code) at load time, targeting session or network handling.", "Mixins/coremods targeting auth-related classes have no ordinary gameplay purpose — verify carefully."),
    "d14": (None, None, "This mod's file was digitally signed, but contains content added after signing, or loads additional external code.", "Treat as a tampered/trojanized copy of a legitimate mod — obtain the mod from its original source instead."),
    "behavior_chain": (None, None, "This mod exhibits a complete multi-step malicious behavior, not just an isolated capability.", "This is a strong, corroborated signal — do not run this mod."),
    "string_reconstruction": ("T1027", "Obfuscated Files or Information", "This mod hides text (such as a URL or class name) inside its code rather than storing it plainly.", "A benign mod has no reason to hide this information — treat as suspicious."),
}
FIELDS = ("mitre_id", "mitre_name", "plain_language", "recommended_action")


def context_for(detector_id: str) -> tuple:
    if detector_id.startswith("rule:") or detector_id == "archive":
        return RULE
    return CONTEXT.get(detector_id, DEFAULT)


def enrich(findings: DataFrame) -> DataFrame:
    """Adds the four context columns; the table of contexts has a fixed, small size."""
    rows = [(k, *v) for k, v in CONTEXT.items()] + [("rule", *RULE), ("", *DEFAULT)]
    known = findings.sparkSession.createDataFrame(rows, "_key string, " + ", ".join(f"{f} string" for f in FIELDS))
    names = list(CONTEXT)
    key = F.when(F.startswith("detector_id", F.lit("rule:")) | (F.col("detector_id") == "archive"), "rule").when(F.col("detector_id").isin(*names), F.col("detector_id")).otherwise("")
    return findings.withColumn("_key", key).join(F.broadcast(known), "_key", "left").drop("_key")
