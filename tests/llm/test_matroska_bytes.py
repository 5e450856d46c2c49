"""Containers written byte by byte from the format's description, not with the package's own writer."""

from driftline.llm import matroska

HEAD = bytes.fromhex("1A45DFA3 8B 4282 88") + b"matroska"
SEGMENT_OF_UNKNOWN_SIZE = bytes.fromhex("18538067 01FFFFFFFFFFFFFF")
INFO = bytes.fromhex("1549A966 87 2AD7B1 83 0F4240")  # a tick is 1,000,000 ns
AUDIO = bytes.fromhex("1654AE6B 90 AE 8E D7 81 01 83 81 02 86 86") + b"A_OPUS"
AUDIO_20_MS = bytes.fromhex("1654AE6B 98 AE 96 D7 81 01 83 81 02 86 86") + b"A_OPUS" + bytes.fromhex("23E383 84 01312D00")


def rows(tracks: bytes, block: bytes):
    cluster = bytes.fromhex("1F43B675") + bytes([0x80 | len(block) + 4]) + bytes.fromhex("E7 82 03E8") + block
    blob = HEAD + SEGMENT_OF_UNKNOWN_SIZE + INFO + tracks + cluster
    return blob, [r for r in matroska._rows(7, blob)]


def of(blob, got):
    return [(r[2], r[3], r[4], r[5], r[6], r[7], r[8], r[9], blob[r[10] : r[11]]) for r in got]


def test_duration_of_a_block_is_shared_by_its_frames():
    # group: block (track 1, +10, Xiph lacing of 3 frames of 3, 5 and 2 bytes), duration 60
    block = bytes.fromhex("A0 97 A1 91 81 000A 02 02 03 05") + b"aaabbbbbcc" + bytes.fromhex("9B 82 003C")
    blob, got = rows(AUDIO, block)
    ms = 1_000_000
    assert of(blob, got) == [(1, "audio", "A_OPUS", (1010 + 20 * k) * ms, 20 * ms, True, "xiph", k, x) for k, x in enumerate((b"aaa", b"bbbbb", b"cc"))]


def test_default_duration_sets_frames_apart():
    # simple block, EBML lacing: sizes 4, 4 + 1, the rest; a key frame
    block = bytes.fromhex("A3 92 81 FFFE 86 02 84 C0") + b"aaaabbbbbcc"
    blob, got = rows(AUDIO_20_MS, block)
    ms = 1_000_000
    assert of(blob, got) == [(1, "audio", "A_OPUS", (998 + 20 * k) * ms, 20 * ms, True, "ebml", k, x) for k, x in enumerate((b"aaaa", b"bbbbb", b"cc"))]


def test_fixed_lacing_and_none():
    blob, got = rows(AUDIO, bytes.fromhex("A3 8B 81 0000 04 01") + b"aaabbb")
    assert [(r[5], r[7], r[8], r[9], blob[r[10] : r[11]]) for r in got] == [(1_000_000_000, False, "fixed", 0, b"aaa"), (1_000_000_000, False, "fixed", 1, b"bbb")]
    blob, got = rows(AUDIO, bytes.fromhex("A3 87 81 0001 80") + b"abc")
    assert [(r[5], r[6], r[7], r[8], blob[r[10] : r[11]]) for r in got] == [(1_001_000_000, None, True, "none", b"abc")]


def test_long_and_cut_off():
    long = b"x" * 200_000
    block = b"\xa3" + bytes([0x10 | (len(long) + 4) >> 24 & 15]) + ((len(long) + 4) & 0xFFFFFF).to_bytes(3, "big") + bytes.fromhex("81 0000 00") + long
    blob = HEAD + SEGMENT_OF_UNKNOWN_SIZE + INFO + AUDIO + bytes.fromhex("1F43B675 01FFFFFFFFFFFFFF E7 81 00") + block
    got = [r for r in matroska._rows(7, blob)]
    assert len(got) == 1 and blob[got[0][10] : got[0][11]] == long and got[0][-1] is None
    cut = [r for r in matroska._rows(7, blob[:-1])]
    assert len(cut) == 1 and cut[0][-1] is not None
