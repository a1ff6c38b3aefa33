"""Voice features of synthetic signals whose pitch, jitter, formants and harmonics are known."""

import numpy as np
import pytest

from kinograph.operators import voice
from kinograph.schemas import VOICE_FEATURES
from kinograph.sources.config import VoiceConfig

RATE = 16000


def pulses(f0, seconds=1.0, jitter=0.0, shimmer=0.0, half=4):
    """A train of short pulses whose periods and amplitudes vary at random, and the shares by which neighbours differ."""
    rng = np.random.default_rng(7)
    x, at, places, heights = np.zeros(int(RATE * seconds)), 40.0, [], []
    bump = np.hanning(2 * half + 1)
    while at < len(x) - half - 1:
        k = int(round(at))
        places.append(k)
        heights.append(1 + shimmer * rng.normal())
        x[k - half : k + half + 1] += bump * heights[-1]
        at += RATE / f0 * (1 + jitter * rng.normal())
    share = lambda v: np.abs(np.diff(v)).mean() / np.mean(v)
    return x, share(np.diff(places)), share(heights)


def vowel(f0, formants, seconds=1.0):
    """Pulses through resonators of (frequency, bandwidth)."""
    y = pulses(f0, seconds)[0]
    for freq, width in formants:
        r = np.exp(-np.pi * width / RATE)
        a, b = 2 * r * np.cos(2 * np.pi * freq / RATE), -r * r
        out = np.zeros(len(y) + 2)
        for i, v in enumerate(y):
            out[i + 2] = v + a * out[i + 1] + b * out[i]
        y = out[2:]
    return y / np.abs(y).max()


def middle(x):
    return np.nanmedian(x[5:-5])


def test_every_default_feature_is_built_in():
    assert set(voice.FEATURES) == set(VOICE_FEATURES) and len(voice.FEATURES) == 25


@pytest.mark.parametrize("method", ["pyin", "yin", "autocorrelation"])
@pytest.mark.parametrize("f0", [100.0, 180.0, 310.0])
def test_pitch(method, f0):
    t = np.arange(RATE) / RATE
    tone = sum(np.sin(2 * np.pi * f0 * k * t) / k for k in range(1, 6))
    f = voice.frame(tone, RATE, VoiceConfig(pitch_method=method))
    assert abs(middle(f.pitch) - f0) < 0.01 * f0
    noise = np.random.default_rng(1).normal(size=RATE)
    assert np.isnan(voice.frame(noise, RATE, VoiceConfig(pitch_method=method)).pitch).mean() > 0.8
    assert np.isnan(voice.frame(np.zeros(RATE), RATE, VoiceConfig(pitch_method=method)).pitch).all()


def test_jitter_and_shimmer():
    for share in (0.0, 0.01, 0.02):
        x, by_period, by_height = pulses(110, 3.0, share, 2 * share, 36)
        f = voice.frame(x, RATE, VoiceConfig())
        assert abs(np.nanmean(voice.jitter(f)) - by_period) < 0.2 * by_period + 0.002
        assert abs(np.nanmean(voice.shimmer(f)) - by_height) < 0.2 * by_height + 0.01
        absolute = voice.jitter(voice.frame(x, RATE, VoiceConfig(jitter_rel=False)))
        assert abs(np.nanmean(absolute) - by_period / 110) < 0.2 * by_period / 110 + 2e-5


def test_formants():
    want = [(700, 80), (1220, 90), (2600, 120), (3400, 150), (4300, 200)]
    f = voice.frame(vowel(110, want), RATE, VoiceConfig(formants_signal_preemphasis_from=50.0))
    for i, (freq, width) in enumerate(want[:3]):
        assert abs(middle(voice.FEATURES[f"f{i + 1}_freq_hz"](f)) - freq) < 0.08 * freq
        assert 0 < middle(voice.FEATURES[f"f{i + 1}_bandwidth_hz"](f)) < 6 * width
    assert middle(voice.FEATURES["f1_amplitude_rel_f0"](f)) > middle(voice.FEATURES["f3_amplitude_rel_f0"](f))


def test_burg_finds_a_resonance():
    r, w = 0.98, 2 * np.pi * 0.1
    rng = np.random.default_rng(2)
    x = np.zeros(4000)
    for i in range(2, 4000):
        x[i] = 2 * r * np.cos(w) * x[i - 1] - r * r * x[i - 2] + rng.normal()
    assert np.allclose(voice.burg(x[None], 2)[0], [1, -2 * r * np.cos(w), r * r], atol=0.02)


def test_harmonics():
    t = np.arange(RATE) / RATE
    f = voice.frame(np.sin(2 * np.pi * 200 * t) + 0.25 * np.sin(2 * np.pi * 400 * t) + 0.05 * np.sin(2 * np.pi * 600 * t), RATE, VoiceConfig())
    assert abs(middle(voice.FEATURES["h1_h2_diff_db"](f)) - 20 * np.log10(4)) < 1
    h, f3 = voice.FEATURES["h1_f3_diff_db"](f), voice.FEATURES["f3_amplitude_rel_f0"](f)
    assert np.allclose(h, -f3, equal_nan=True)
    with pytest.raises(ValueError):
        voice.harmonic_difference(x_type="q")


def test_cepstra_start_with_the_constant():
    rng = np.random.default_rng(3)
    x = rng.normal(size=RATE) * 0.1
    plain = VoiceConfig(mfcc_lifter=0.0)
    a, b = voice.frame(x, RATE, plain).mfccs, voice.frame(10 * x, RATE, plain).mfccs
    assert np.allclose((b - a)[:, 0], 20 * np.sqrt(26)) and np.allclose((b - a)[:, 1:], 0, atol=1e-6)  # 20 dB in each of 26 bands
    lifted = voice.frame(x, RATE, VoiceConfig()).mfccs
    assert np.allclose(lifted / a, 1 + 11 * np.sin(np.pi * np.arange(1, 5) / 22))
    assert np.allclose(voice.FEATURES["mfcc_1"](voice.frame(x, RATE, plain)), a[:, 0])


def test_settings_are_honoured():
    x = vowel(120, [(500, 80)], 0.3)
    a, b = (voice.frame(x, RATE, VoiceConfig(spec_window=w)).magnitude for w in ("hann", "hamming"))
    assert not np.allclose(a, b)
    for bad in ({"spec_window": "none"}, {"pitch_method": "none"}):
        with pytest.raises(ValueError):
            voice.FEATURES["h1_h2_diff_db"](voice.frame(x, RATE, VoiceConfig(**bad)))
    with pytest.raises(ValueError):
        voice.FEATURES["spectral_slope_0_500"](voice.frame(x, RATE, VoiceConfig(spectral_slopes_bands=((0.0, 400.0), (500.0, 1500.0)))))


def test_harmonics_to_noise_ratio():
    t = np.arange(RATE) / RATE
    tone = np.sin(2 * np.pi * 150 * t)
    noise = np.random.default_rng(4).normal(size=RATE) * np.sqrt(0.5)
    found = [middle(voice.hnr_db(voice.frame(tone + share * noise, RATE, VoiceConfig()))) for share in (0.05, 0.3)]
    assert abs(found[1] - 20 * np.log10(1 / 0.3)) < 2 and found[0] > found[1] + 8


def test_empty_and_short_signals(spark):
    for n in (0, 1, 100):
        f = voice.frame(np.zeros(n), RATE, VoiceConfig())
        for name, feature in voice.FEATURES.items():
            assert len(feature(f)) == len(f.times), name
    rows = spark.createDataFrame([("a", 16000.0, [0.0] * 3000), ("b", 16000.0, pulses(120, 0.3)[0].tolist())], "filename string, rate double, samples array<double>")
    long = voice.extract(rows)
    assert long.select("feature").distinct().count() == 25
    assert long.where("filename = 'b' AND feature = 'jitter_local_rel_f0' AND value IS NOT NULL").count() > 5
    assert long.where("filename = 'a' AND feature = 'pitch_f0_hz' AND value IS NOT NULL").count() == 0


def test_custom_feature_with_requirements(spark):
    peak = voice.Feature(lambda frames, rate: np.abs(frames).max(1) * rate, ("frames", "rate"))
    rows = spark.createDataFrame([("b", 16000.0, [0.5] * 2000)], "filename string, rate double, samples array<double>")
    assert {r.value for r in voice.extract(rows, {"peak": peak}).collect()} == {8000.0}
    with pytest.raises(TypeError):
        voice.Feature(lambda x: x, ("nothing",))
    with pytest.raises(TypeError):
        voice.extract(rows, {1: peak})
