"""Constants handed to decoders: each form, chains, and what ends them."""

import base64
import codecs
import gzip
import zlib

import pytest

from sievework.operators import constants

CODE = b"eval($_POST[1]);"
b64 = lambda x: base64.b64encode(x).decode()
rot = lambda x: codecs.encode(x, "rot13")
raw = lambda x: (lambda c: c.compress(x) + c.flush())(zlib.compressobj(wbits=-15))
chars = ".".join(f"chr({c})" for c in CODE)
P = CODE.decode()

CASES = [
    ("gzinflate( base64_decode( '" + b64(raw(CODE)) + "' ) )", [("base64_decode→gzinflate", P)]), ("base64_decode( '" + b64(CODE) + "' )", [("base64_decode", P)]), (chars, [("chr", P)]),
    ("chr(101).chr(118).chr(97).chr(108)", []), (" . ".join(f"chr( {hex(c)} )" for c in CODE), [("chr", P)]), ("+".join(f"chr({c})" for c in CODE), []), ("pack( 'H*', '" + CODE.hex() + "' )", [("pack", P)]), ("pack( 'N', '00' )", []),
    ("base64_decode( base64_decode( base64_decode( base64_decode( '" + b64(b64(b64(b64(CODE).encode()).encode()).encode()) + "' ) ) ) )", [("base64_decode→base64_decode→base64_decode", b64(CODE))]),
    ("base64_decode( str_rot13( base64_decode( '" + b64(rot(b64(CODE)).encode()) + "' ) ) )", [("base64_decode→str_rot13→base64_decode", P)]),
    ("gzinflate( base64_decode( '" + b64(CODE) + "' ) . $tail )", [("base64_decode", P)]), ("gzinflate( base64_decode( 'zzzzzzzzzzzz' ) )", [("base64_decode", base64.b64decode("zzzzzzzzzzzz").decode("latin-1"))]),
    ("base64_decode( $_POST['p'] )", []), ("base64_decode( \"$x\" )", []), ("base64_decode( 'no-base64!' )", []), ("gzinflate\n\t(base64_decode ( '" + b64(raw(CODE)) + "' ) )", [("base64_decode→gzinflate", P)]),
    ("base64_decode( '" + b64(CODE)[:5] + "' . '" + b64(CODE)[5:9] + "'.\"" + b64(CODE)[9:] + "\" )", [("base64_decode", P)]), ("base64_decode( '" + b64(CODE) + "' . $x )", []),
    ("hex2bin( '" + CODE.hex() + "' )", [("hex2bin", P)]), ("strrev( '" + P[::-1] + "' )", [("strrev", P)]), ("str_rot13( \"" + rot(P).replace("$", "\\x24") + "\" )", [("str_rot13", P)]),
    ("urldecode( '%65val(+1)' )", [("urldecode", "eval( 1)")]), ("rawurldecode( '%65val(+1)' )", [("rawurldecode", "eval(+1)")]),
    ("gzuncompress( base64_decode( '" + b64(zlib.compress(CODE)) + "' ) )", [("base64_decode→gzuncompress", P)]), ("gzdecode( base64_decode( '" + b64(gzip.compress(CODE)) + "' ) )", [("base64_decode→gzdecode", P)]),
    ("strrev( " + ".".join(f"chr({c})" for c in CODE[::-1]) + " )", [("chr→strrev", P)]), ("gzinflate( base64_decode( '" + b64(raw(b"A" * 60_000_000)) + "' ) )", None), ("base64_decode( '' )", []),
    (".".join(f"chr({c})" for c in ("0x" + "f" * 40, "0b" + "1" * 90, "9" * 60, "0" + "7" * 50, *CODE[:8])), [("chr", "\xff\xff\xff" + P[:8])]),
    ("'base64_decode(\\'" + b64(CODE) + "\\')'", []), ("/* base64_decode('" + b64(CODE) + "') */ 1", []),
]


@pytest.fixture(scope="module")
def found(spark):
    got: dict[int, list] = {}
    files = [(str(i), f"<?php\n$x = {code};\n") for i, (code, _) in enumerate(CASES)] + [("none", None), ("empty", "")]
    for r in constants.decoded(spark.createDataFrame(files, "path string, text string")).collect():
        assert r.line == 2
        got.setdefault(int(r.path), []).append(("→".join(r.chain), r.payload))
    return got


@pytest.mark.parametrize("i", range(len(CASES)))
def test_case(found, i):
    got, want = found.get(i, []), CASES[i][1]
    if want is None:  # a bomb ends the chain; what is left is its compressed form
        assert [c for c, _ in got] == ["base64_decode"] and len(got[0][1]) < 262_144
    else:
        assert got == want
