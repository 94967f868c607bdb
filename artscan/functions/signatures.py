"""Names, patterns and thresholds that results depend on."""
from __future__ import annotations

# --- invoked methods --------------------------------------------------------
PROCESS_CALLS = (("java/lang/Runtime", "exec"), ("java/lang/ProcessBuilder", "<init>"), ("java/lang/ProcessBuilder", "start"))
PROCESS_STRINGS = ("java.lang.Runtime", "java/lang/Runtime", "getRuntime", "ProcessBuilder")
NETWORK_OWNERS = (
    "java/net/URL", "java/net/HttpURLConnection", "java/net/Socket", "java/net/ServerSocket", "java/net/DatagramSocket",
    "java/net/http/HttpClient", "java/net/http/HttpRequest", "java/net/http/HttpResponse",
    "okhttp3/OkHttpClient", "org/apache/http/client/HttpClient",
)
URL_PATTERN = r"""https?://[^\s"'\(\)]+"""
WEBHOOKS = ("discord.com/api/webhooks/", "discordapp.com/api/webhooks/")
LEGITIMATE_DOMAINS = (
    "maven.apache.org", "repo1.maven.org", "central.sonatype.org", "github.com", "raw.githubusercontent.com", "jitpack.io",
    "minecraft.net", "mojang.com", "fabricmc.net", "minecraftforge.net", "files.minecraftforge.net",
)
LOADER_OWNERS = ("java/net/URLClassLoader", "java/security/SecureClassLoader")
LOADER_CALLS = (("java/lang/ClassLoader", "defineClass"), ("java/lang/Class", "forName"))
STDLIB_PREFIXES = ("kotlin/", "kotlinx/", "org/jetbrains/", "it/unimi/dsi/fastutil/", "com/google/gson/", "org/apache/commons/")
FILE_OWNERS = (
    "java/util/zip/ZipOutputStream", "java/util/zip/ZipFile", "java/util/jar/JarFile", "java/util/jar/JarOutputStream",
    "java/nio/file/Files", "java/nio/file/Paths", "java/io/FileOutputStream", "java/io/FileInputStream", "java/io/RandomAccessFile",
)
ACCOUNT_FILES = ("launcher_accounts.json", "launcher_profiles.json")
INDIRECT_OWNERS = (
    "java/lang/invoke/MethodHandles", "java/lang/invoke/MethodHandle", "java/lang/invoke/LambdaMetafactory", "java/lang/invoke/VarHandle",
    "java/lang/StackWalker", "sun/misc/Unsafe", "jdk/internal/misc/Unsafe",
)
CRYPTO_OWNERS = ("java/security/Signature", "javax/crypto/Cipher")
CRYPTO_NAMES = ("verify", "initVerify", "doFinal")

# --- strings ----------------------------------------------------------------
STRONG_PERSISTENCE = (
    "SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Run",
    "SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\RunOnce",
    "\\Start Menu\\Programs\\Startup",
    "AppData\\Roaming\\Microsoft\\Windows\\Start Menu\\Programs\\Startup",
    "/etc/systemd/system/",
    "/etc/cron.d/",
    "/etc/cron.daily/",
    "schtasks.exe",
    "cmd.exe /c schtasks",
)
WEAK_PERSISTENCE = ("schtasks", "crontab", "systemctl", "/etc/cron", "powershell -command")
STAGING = ("createTempFile", "deleteOnExit")
BENIGN_LIBRARIES = ("lwjgl", "glfw", "openal", "joml", "jemalloc", "opengl32", "stb")
LIBRARY_EXTENSIONS = (".dll", ".so", ".dylib")
NATIVE_LOADER = "JNICLoader"
#: No source text of this detector is at hand; the table follows its description.
CREDENTIAL_NAMES = ("getSession", "getAccessToken", "getUsername", "getUuid")
CREDENTIAL_STRINGS = ("launcher_accounts.json", "discord/Local Storage/leveldb", "discord\\Local Storage\\leveldb", "Login Data", "Cookies")
CREDENTIAL_PLACES = (".minecraft", "launcher")
SELECTOR = "ce6d41de"
#: Compared with lower-cased strings, so the two names in mixed case match nothing.
CHAIN_MARKERS = ("eth_call", "eth_getStorageAt", "eth_getCode", "infura.io", "alchemyapi.io", "etherscan.io", "publicnode.com", "drpc.org", "rpc.ankr.com")
AUTH_TARGETS = ("YggdrasilAuthenticationService", "YggdrasilUserApiService", "MinecraftSession", "net/minecraft/client/util/Session", "net/minecraft/util/Session", "class_321", "class_332", "class_45")
NETWORK_TARGETS = ("PacketEncoder", "PacketDecoder", "class_2538", "class_2540")
CONFIG_FRAGMENTS = ("Session", "YggdrasilAuthenticationService", "YggdrasilUserApiService", "PacketEncoder", "PacketDecoder")
MIXIN = "org/spongepowered/asm/mixin/Mixin;"
MIXIN_REPLACING = ("org/spongepowered/asm/mixin/injection/Redirect;", "org/spongepowered/asm/mixin/Overwrite;")
COREMOD_KEYS = ("FMLCorePlugin", "FMLCorePluginContainsFMLMod")

# --- thresholds -------------------------------------------------------------
ENTROPY_LENGTH, ENTROPY_LIMIT = 12, 5.8
DISPATCH_TARGETS, GOTO_RATIO, BACK_FRACTION, LOOP_WINDOW = 4, 0.5, 0.6, 8
LOOP_OPCODES = (*range(153, 167), 190)
PNG_LIMIT = 1024 * 1024
FUNCTION_LIMIT = 50
SCRIPT_LIMIT = 1024 * 1024

# --- correlation ------------------------------------------------------------
CHAINS = {
    "credential_exfiltration": (("d08", "d02", "d09"), "Credential access + network I/O + obfuscation in the same class: reads a credential, sends it somewhere, and hides the destination"),
    "reload_and_execute": (("d02", "d04", "d03"), "Network fetch + file write + dynamic class loading in the same class: downloads a payload, stages it on disk, then loads it as code"),
    "native_payload_staging": (("d07", "d04"), "Native library loading + filesystem write in the same class: unpacks and loads an unpacked native payload at runtime"),
}
EXEMPT_MARKERS = ("reconstructed", "rule_pack")
DANGEROUS_REFERENCES = (
    "java.lang.Runtime", "java/lang/Runtime", "java.lang.ProcessBuilder", "java/lang/ProcessBuilder", "getRuntime", "exec", "ProcessBuilder",
    "java.net.URLClassLoader", "URLClassLoader", "java.lang.Class.forName", "Class.forName", "MethodHandles", "LambdaMetafactory", "defineClass", "loadClass",
)

# --- scripts: (type, pattern, description) ------------------------------------
SCRIPT_GENERIC = (
    ("op_command", r"^\s*/op\s+\S", "op command usage"),
    ("gamemode", r"/gamemode\s+creative", "gamemode change"),
    ("command_block", r"/give\s+.*command_block", "command block giveaway"),
    ("execute_all", r"execute\s+.*at\s+@a\s+run", "execute on all players"),
)
SCRIPT_MCFUNCTION = (
    ("data_merge", r"^\s*/data\s+merge", "data merge operation"),
    ("scoreboard_remove", r"^\s*/scoreboard\s+objectives\s+remove", "scoreboard removal"),
    ("kill_all_entities", r"^\s*/kill\s+@e", "kill all entities"),
    ("summon_named", r"^\s*/summon\s+.*custom_name", "summon with custom name"),
)
SCRIPT_JS = (
    ("runtime_exec", r"""Java\.type\s*\(\s*["']java\.lang\.Runtime""", "Java Runtime exec access"),
    ("process_builder", r"java\.lang\.ProcessBuilder", "ProcessBuilder usage"),
    ("java_net", r"java\.net\.URL", "Java net URL access"),
    ("http_client", r"java\.net\.http\.HttpClient", "Java HttpClient access"),
    ("java_io_file", r"java\.io\.File", "Java File access"),
    ("script_engine", r"javax\.script\.ScriptEngine", "ScriptEngine eval"),
    ("eval", r"\beval\s*\(", "eval() usage"),
    ("function_constructor", r"""Function\s*\(\s*["']""", "Function constructor"),
    ("fetch", r"fetch\s*\(", "fetch() usage"),
)
SCRIPT_NETWORK = (r"(?:fetch|XMLHttpRequest|axios)\s*\([^)]*\)", r"java\.net\.(?:URL|HttpClient|HttpURLConnection)[^;]*;")
SCRIPT_FILES = (r"java\.io\.File[^;]*;", r"Files\.(?:read|write|create|delete|walk)[^;]*;", r"(?:readFile|writeFile|readFileSync|writeFileSync)\s*\([^)]*\)")
NOT_CALLS = ("function", "if", "for", "while", "return", "new", "const", "let", "var", "import", "export")

# --- rule generation ----------------------------------------------------------
GENERIC_MEMBERS = ("<init>", "<clinit>", "start", "run", "get", "set", "exec", "load", "close", "open", "read", "write", "call", "init")
