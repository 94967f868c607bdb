"""Archives for tests, compiled from the sources below."""
import io
import shutil
import subprocess
import zipfile
from pathlib import Path

SOURCES = {
    "Quiet": "public class Quiet { static int add(int a, int b) { int s = 0; for (int i = 0; i < b; i++) { switch (i) { case 0: s += 1; break; case 1: s += 2; break; case 2: s += 3; break; case 3: s += 4; break; default: s += a; } } return s; } }",
    "Runs": 'public class Runs { static void go() throws Exception { Runtime.getRuntime().exec("ls"); new ProcessBuilder("x").start(); } }',
    "Bytes": 'public class Bytes { static String url() { return new String(new byte[]{104,116,116,112,115,58,47,47,101,118,105,108,46,116,101,115,116,47,97}); } }',
    "Chars": "public class Chars { static String s() { return new String(new char[]{'j','a','v','a','.','l','a','n','g','.','R','u','n','t','i','m','e'}); } static Class<?> c() throws Exception { return Class.forName(s()); } }",
    "Encoded": 'public class Encoded { static String s() { return new String(java.util.Base64.getDecoder().decode("aHR0cHM6Ly9ldmlsLnRlc3QvYg==")); } }',
    "Xored": "public class Xored { static String k = \"secretkey\"; static byte[] d() { return new byte[]{%s}; } }",
    "Sealed": "import javax.crypto.*; import javax.crypto.spec.*; public class Sealed { static byte[] s() throws Exception { byte[] k = new byte[]{%s}; byte[] d = new byte[]{%s}; Cipher c = Cipher.getInstance(\"AES/ECB/NoPadding\"); c.init(2, new SecretKeySpec(k, \"AES\")); return c.doFinal(d); } }",
    "Refs": "public class Refs { static java.util.function.Function<String,Integer> f() { return Integer::parseInt; } }",
    "Flat": "public class Flat { static int run(int x) { int state = 0; while (true) { switch (state) { case 0: x++; state = 3; break; case 1: x += 2; state = 4; break; case 2: x *= 3; state = 1; break; case 3: x -= 4; state = 2; break; case 4: return x; default: state = 0; } } } }",
    "Boxed": "public class Boxed { static String load(int[] a, int[] b, int c, int d) { return null; } static String s() { int[] a = new int[]{%s}; int[] b = new int[]{%s}; return load(a, b, 42, 3); } }",
    "Natives": 'public class Natives { static void go() throws Exception { java.io.File f = java.io.File.createTempFile("p", ".dll"); f.deleteOnExit(); java.nio.file.Files.copy(new java.io.FileInputStream("payload.dll"), f.toPath()); System.load(f.getPath()); } }',
    "Starts": 'public class Starts { static void go() throws Exception { Runtime.getRuntime().exec("schtasks /create"); } }',
    "Chain": 'public class Chain { static Object go() { return "eth_call at https://rpc.ankr.com/x"; } static boolean ok(java.security.Signature s, byte[] b) throws Exception { return s.verify(b); } }',
}
KEY = b"0123456789abcdef"
AES_TEXT = b"https://evil.test/collect"
XOR_TEXT = b"http://evil.test/Xored/0123456789/PATH/with/a/Rather/long/TAIL/9876543210/that/Goes/on/And/on/and/ON.php"


def box(text: bytes, k1: int = 42, k2: int = 3):
    """The arrays that the substitution cipher turns back into ``text``."""
    out = []
    for b in text:
        v = (b * 53 + 97) % 256
        v = ((v << k2) | (v >> (8 - k2))) & 0xFF
        out.append(v ^ k1)
    return out[0::2], out[1::2]


def compile_all(folder: Path, sealed: bytes) -> dict[str, bytes]:
    signed = lambda data: ",".join(str(b - 256 if b > 127 else b) for b in data)
    xored = bytes(b ^ b"secre"[i % 5] for i, b in enumerate(XOR_TEXT))
    fill = {"Xored": (signed(xored),), "Sealed": (signed(KEY), signed(sealed)), "Boxed": tuple(",".join(map(str, p)) for p in box(b"https://evil.test/boxed"))}
    for name, text in SOURCES.items():
        (folder / f"{name}.java").write_text(text % fill[name] if name in fill else text)
    subprocess.run([shutil.which("javac"), "-nowarn", "-d", str(folder), *map(str, folder.glob("*.java"))], check=True, capture_output=True)
    return {n: (folder / f"{n}.class").read_bytes() for n in SOURCES}


def jar(entries: dict[str, bytes | str], stored: bool = False) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED) as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()
