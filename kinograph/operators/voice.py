"""Voice features of audio signals: signal processing by NumPy in Arrow batches, resampling by SQL.

A stage gives the long table (filename, feature, ts, value), which operators.interpolate.resample puts on a grid. A feature is
a function of Frames, which makes each intermediate result (spectra, pitch, pulses, formants, ...) once, when it is first
asked for. All 25 default features are built in; others are added to FEATURES by name, or are a Feature that names the
intermediate results it requires.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from kinograph.schemas import VOICE_FEATURES
from kinograph.sources.config import VoiceConfig

LONG = "filename string, feature string, ts double, value double"


def _gaussian(n: int) -> np.ndarray:
    """A bell that is 0 just outside of the window, as phonetics programs use it for formants."""
    x = (np.arange(1, n + 1) - (n + 1) / 2) / (n + 1)
    return (np.exp(-48 * x**2) - np.exp(-12)) / (1 - np.exp(-12))


def _cosines(*weights: float) -> Callable[[int], np.ndarray]:
    return lambda n: sum(w * np.cos(2 * np.pi * k * np.arange(n) / n) for k, w in enumerate(weights))


WINDOWS: dict[str, Callable[[int], np.ndarray]] = {
    "hann": _cosines(0.5, -0.5), "hamming": _cosines(0.54, -0.46), "blackman": _cosines(0.42, -0.5, 0.08),
    "boxcar": np.ones, "rectangular": np.ones, "praat_gaussian": _gaussian,
}


def window(name: str, n: int) -> np.ndarray:
    if name not in WINDOWS:
        raise ValueError(f"no such window: {name}")
    return WINDOWS[name](n)


def _db(x: np.ndarray, factor: float = 10.0) -> np.ndarray:
    return factor * np.log10(np.where(x > 0, x, np.nan))


def _divide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(np.broadcast(a, b).shape, np.nan), where=b > 0)


class Frames:
    """What features are made from. Arrays have a row for each frame; what a frame lacks is NaN."""

    def __init__(self, signal: np.ndarray, rate: float, config: VoiceConfig):
        self.signal, self.rate, self.config = np.asarray(signal, float), float(rate), config

    def _framed(self, signal: np.ndarray) -> np.ndarray:
        n, hop = self.config.frame_len, self.config.hop_len
        x = np.pad(signal, n // 2, mode=self.config.pad_mode) if self.config.center and len(signal) else signal
        if len(x) < n:
            x = np.pad(x, (0, n - len(x)))
        return np.lib.stride_tricks.sliding_window_view(x, n)[::hop]

    @cached_property
    def frames(self) -> np.ndarray:
        return self._framed(self.signal)

    @cached_property
    def times(self) -> np.ndarray:
        return np.arange(len(self.frames)) * self.config.hop_len / self.rate + (0 if self.config.center else self.config.frame_len / 2 / self.rate)

    @cached_property
    def windowed(self) -> np.ndarray:
        return self.frames * window(self.config.spec_window, self.config.frame_len)

    @cached_property
    def magnitude(self) -> np.ndarray:
        return np.abs(np.fft.rfft(self.windowed, axis=1))

    @cached_property
    def freqs(self) -> np.ndarray:
        return np.fft.rfftfreq(self.config.frame_len, 1 / self.rate)

    @cached_property
    def pitch(self) -> np.ndarray:
        """F0 in Hz; NaN where a frame is not voiced."""
        methods = {"pyin": probable_pitch, "yin": yin_pitch, "autocorrelation": autocorrelation_pitch}
        if self.config.pitch_method not in methods:
            raise ValueError(f"no such method for pitch: {self.config.pitch_method}")
        return methods[self.config.pitch_method](self)

    @cached_property
    def pulses(self) -> tuple[np.ndarray, np.ndarray]:
        """Times, in samples of the frame, and amplitudes of glottal pulses, in order."""
        return glottal_pulses(self)

    @cached_property
    def formants(self) -> tuple[np.ndarray, np.ndarray]:
        """Frequencies and bandwidths in Hz, in the order of frequencies; config.formants_max columns."""
        return formant_tracks(self)

    @cached_property
    def harmonics(self) -> np.ndarray:
        """Magnitudes at the first config.pitch_n_harmonics multiples of the pitch, between bins by linear interpolation."""
        at = self.pitch[:, None] * np.arange(1, self.config.pitch_n_harmonics + 1) / (self.freqs[1] - self.freqs[0])
        low = np.floor(np.nan_to_num(at)).astype(int)
        inside = ~np.isnan(at) & (low + 1 < self.magnitude.shape[1])
        low = np.where(inside, low, 0)
        a, b = (np.take_along_axis(self.magnitude, k, 1) for k in (low, low + 1))
        return np.where(inside, a + (b - a) * (at - low), np.nan)

    @cached_property
    def formant_amplitudes(self) -> np.ndarray:
        """In dB, the strongest harmonic around each formant; relative to the first harmonic unless config says otherwise."""
        c, freqs = self.config, self.formants[0]
        multiples = self.pitch[:, None] * np.arange(1, c.pitch_n_harmonics + 1)
        out = np.full(freqs.shape, np.nan)
        for k in range(freqs.shape[1]):
            f = freqs[:, k : k + 1]
            with np.errstate(invalid="ignore"):
                near = (multiples >= c.formants_amp_lower * f) & (multiples <= c.formants_amp_upper * f) & ~np.isnan(self.harmonics)
            best = np.where(near, self.harmonics, -1.0).max(1)
            out[:, k] = _db(best, 20.0) - (_db(self.harmonics[:, 0], 20.0) if c.formants_amp_rel_f0 else 0)
        return out

    @cached_property
    def mel_spectrum(self) -> np.ndarray:
        return self.magnitude**2 @ mel_filters(self).T

    @cached_property
    def mfccs(self) -> np.ndarray:
        """The first config.mfcc_n coefficients of the mel spectrum in dB, liftered; the first one is that of the constant."""
        level = 10 * np.log10(np.maximum(self.mel_spectrum, 1e-10))
        level = np.maximum(level, level.max(initial=-100.0) - 80)
        n, c = level.shape[1], self.config
        k = np.arange(c.mfcc_n)
        basis = np.sqrt(np.where(k == 0, 1, 2) / n) * np.cos(np.pi * k * (np.arange(n)[:, None] + 0.5) / n)
        return level @ basis * (1 + c.mfcc_lifter / 2 * np.sin(np.pi * (k + 1) / c.mfcc_lifter) if c.mfcc_lifter > 0 else 1)

    @cached_property
    def correlation(self) -> np.ndarray:
        """Autocorrelation of each frame less its mean, by overlap, divided by that of lag 0; up to half a frame."""
        x = self.frames - self.frames.mean(1, keepdims=True)
        n = x.shape[1]
        r = np.fft.irfft(np.abs(np.fft.rfft(x, 2 * n, axis=1)) ** 2, axis=1)[:, : n // 2 + 1] / np.arange(n, n - n // 2 - 1, -1)
        return _divide(r, r[:, :1])


def frame(signal: np.ndarray, rate: float, config: VoiceConfig) -> Frames:
    return Frames(signal, rate, config)


def _lags(f: Frames, low: float, high: float) -> tuple[int, int]:
    """Least and greatest lag of frequencies from low to high."""
    return max(2, int(f.rate / high)), min(f.config.frame_len // 2 - 1, int(np.ceil(f.rate / max(low, 1e-9))))


def _peak(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and height of a parabola through each row's value at a place and its two neighbours."""
    at = np.clip(at, 1, values.shape[1] - 2)
    rows = np.arange(len(at))
    a, b, c = (values[rows, at + k] for k in (-1, 0, 1))
    curve = a - 2 * b + c
    shift = np.where(curve != 0, np.clip(np.divide(0.5 * (a - c), curve, out=np.zeros(len(a)), where=curve != 0), -1, 1), 0)
    return at + shift, b - 0.25 * (a - c) * shift


def autocorrelation_pitch(f: Frames, octave_cost: float = 0.02) -> np.ndarray:
    """Pitch where the greatest autocorrelation within the pitch range exceeds one half; of peaks alike, that of the least lag."""
    low, high = _lags(f, f.config.pitch_lower_freq, f.config.pitch_upper_freq)
    part = np.nan_to_num(f.correlation, nan=-1.0)
    a, b, c = part[:, low - 1 : high], part[:, low : high + 1], part[:, low + 1 : high + 2]
    curve = np.where((b > a) & (b >= c), a - 2 * b + c, -np.inf)
    height = np.where(np.isfinite(curve), b - (a - c) ** 2 / np.where(np.isfinite(curve) & (curve != 0), 8 * curve, -1.0), -1.0)
    lag, peak = _peak(part, low + (height - octave_cost * np.log2(np.arange(low, high + 1))).argmax(1))
    return np.where(peak > 0.5, f.rate / lag, np.nan)


def yin_difference(f: Frames, longest: int) -> np.ndarray:
    """The cumulative mean normalised difference of half a frame against itself, for lags from 0 to longest."""
    x = f.frames
    n = x.shape[1]
    w = n - longest
    power = np.cumsum(np.pad(x**2, ((0, 0), (1, 0))), axis=1)
    lags = np.arange(longest + 1)
    size = 1 << (2 * n - 1).bit_length()
    cross = np.fft.irfft(np.conj(np.fft.rfft(x[:, :w], size, axis=1)) * np.fft.rfft(x, size, axis=1), axis=1)[:, : longest + 1]
    d = np.maximum(power[:, w : w + 1] + power[:, lags + w] - power[:, lags] - 2 * cross, 0)
    d[:, 0] = 0
    mean = np.cumsum(d, axis=1)
    out = np.ones_like(d)
    np.divide(d[:, 1:] * lags[1:], mean[:, 1:], out=out[:, 1:], where=mean[:, 1:] > 1e-12)
    return out


def _dips(f: Frames) -> tuple[np.ndarray, np.ndarray, int]:
    """The normalised difference, which of its lags are local minima within the pitch range, and the least lag."""
    low, high = _lags(f, f.config.pitch_lower_freq, f.config.pitch_upper_freq)
    d = yin_difference(f, high + 1)
    dip = np.zeros(d.shape, bool)
    dip[:, 1:-1] = (d[:, 1:-1] < d[:, :-2]) & (d[:, 1:-1] <= d[:, 2:])
    dip[:, :low] = False
    return d, dip, low


def yin_pitch(f: Frames, threshold: float = 0.1) -> np.ndarray:
    """Pitch of the first dip under the threshold."""
    d, dip, _ = _dips(f)
    under = dip & (d < threshold)
    at = under.argmax(1)
    return np.where(under.any(1), f.rate / _peak(d, at)[0], np.nan)


def probable_pitch(f: Frames, states: int = 5, jump: float = 12.0, switch: float = 0.01) -> np.ndarray:
    """Pitch by the probabilistic form of YIN.

    The threshold has a beta distribution (2, 18), so each dip has the probability that it is the first one under it. Of the
    ``states`` likeliest dips of each frame, and a state that is not voiced, the best path is found: ``switch`` is the
    probability of becoming voiced or unvoiced, ``jump`` the cost of an octave.
    """
    d, dip, low = _dips(f)
    below = lambda x: 1 - (1 - x) ** 19 - 19 * x * (1 - x) ** 18
    seen = np.where(dip, d, 1.0)
    before = np.minimum.accumulate(np.c_[np.ones(len(d)), seen[:, :-1]], axis=1)
    p = np.where(dip & (d < before), below(np.clip(before, 0, 1)) - below(np.clip(d, 0, 1)), 0.0)
    k = min(states, p.shape[1])
    best = np.argpartition(-p, k - 1, axis=1)[:, :k]
    weight = np.take_along_axis(p, best, 1)
    lag = np.stack([_peak(d, best[:, j])[0] for j in range(k)], 1)
    octave = np.log2(lag)
    voiced = weight.sum(1)
    emit = np.log(np.c_[weight, np.maximum(1 - voiced, 0)] + 1e-12)
    t = len(d)
    back = np.zeros((t, k + 1), int)
    score = emit[0] if t else np.zeros(k + 1)
    stay, change = np.log(1 - switch), np.log(switch)
    move = np.empty((k + 1, k + 1))
    for i in range(1, t):
        move[:k, :k] = stay - jump * np.abs(octave[i - 1][:, None] - octave[i][None])
        move[:k, k] = move[k, :k] = change
        move[k, k] = stay
        total = score[:, None] + move
        back[i] = total.argmax(0)
        score = total[back[i], np.arange(k + 1)] + emit[i]
    path = np.empty(t, int)
    if t:
        path[-1] = score.argmax()
        for i in range(t - 1, 0, -1):
            path[i - 1] = back[i][path[i]]
    is_voiced = (path < k) & (f.frames.std(1) > 0)
    return np.where(is_voiced, f.rate / lag[np.arange(t), np.minimum(path, k - 1)], np.nan)


def glottal_pulses(f: Frames) -> tuple[np.ndarray, np.ndarray]:
    """From the greatest peak near the middle of a voiced frame, the greatest within a fifth of each next period, both ways."""
    rows = np.flatnonzero(~np.isnan(f.pitch))
    n = f.config.frame_len
    if not len(rows):
        return np.full((len(f.pitch), 1), np.nan), np.full((len(f.pitch), 1), np.nan)
    x, period = f.frames[rows], f.rate / f.pitch[rows]
    sign = np.where(x.max(1) >= -x.min(1), 1.0, -1.0)
    x = x * sign[:, None]

    def greatest(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.ceil(low).astype(int), np.floor(high).astype(int)
        at = low[:, None] + np.arange(max(1, int((high - low).max()) + 1))
        ok = (at <= high[:, None]) & (at >= 0) & (at < n)
        part = np.where(ok, np.take_along_axis(x, np.clip(at, 0, n - 1), 1), -np.inf)
        k = part.argmax(1)
        place, height = _peak(x, low + k)
        whole = (low >= 0) & (high < n) & ok.any(1) & (height > 0)
        return np.where(whole, place, np.nan), np.where(whole, height, np.nan)

    middle = greatest(n / 2 - period / 2, n / 2 + period / 2)
    found = [middle]
    for way in (-1, 1):
        at = middle[0]
        side = []
        for _ in range(int(n / period.min()) + 1):
            centre = np.nan_to_num(at + way * period, nan=-1e6)
            at, height = greatest(centre - 0.2 * period, centre + 0.2 * period)
            if np.isnan(at).all():
                break
            side.append((at, height))
        found = [*reversed(side), *found] if way < 0 else [*found, *side]
    out = []
    for part in zip(*found):
        whole = np.full((len(f.pitch), len(found)), np.nan)
        whole[rows] = np.stack(part, 1)
        out.append(whole)
    return out[0], out[1]


def _period_pairs(f: Frames) -> tuple[np.ndarray, np.ndarray]:
    """Pitch periods in seconds, NaN where out of bounds, and which neighbours are alike enough to be compared."""
    c = f.config
    period = np.diff(f.pulses[0], axis=1) / f.rate
    with np.errstate(invalid="ignore", divide="ignore"):
        period = np.where((period >= c.pitch_pulse_lower_period) & (period <= c.pitch_pulse_upper_period), period, np.nan)
        ratio = period[:, 1:] / period[:, :-1]
        return period, np.maximum(ratio, 1 / ratio) <= c.pitch_pulse_max_period_ratio


def _mean(x: np.ndarray, use: np.ndarray) -> np.ndarray:
    return _divide(np.where(use, x, 0).sum(1), use.sum(1).astype(float))


def jitter(f: Frames) -> np.ndarray:
    """Mean difference of consecutive pitch periods, relative to the mean period."""
    period, alike = _period_pairs(f)
    out = _mean(np.abs(np.diff(period, axis=1)), alike)
    return _divide(out, np.nan_to_num(_mean(period, ~np.isnan(period)))) if f.config.jitter_rel else out


def shimmer(f: Frames) -> np.ndarray:
    """Mean difference of the amplitudes of consecutive pitch periods, relative to the mean amplitude."""
    period, alike = _period_pairs(f)
    amp = np.where(np.isnan(period), np.nan, f.pulses[1][:, :-1])
    with np.errstate(invalid="ignore", divide="ignore"):
        ratio = amp[:, 1:] / amp[:, :-1]
        alike = alike & (np.maximum(ratio, 1 / ratio) <= f.config.pitch_pulse_max_amp_factor)
    out = _mean(np.abs(np.diff(amp, axis=1)), alike)
    return _divide(out, np.nan_to_num(_mean(amp, ~np.isnan(amp)))) if f.config.shimmer_rel else out


def burg(x: np.ndarray, order: int) -> np.ndarray:
    """Linear predictive coefficients (1, a1, ..., order) of each row, by Burg's recursion."""
    forward, backward = x[:, 1:].copy(), x[:, :-1].copy()
    a = np.zeros((len(x), order + 1))
    a[:, 0] = 1
    for m in range(order):
        k = -2 * _divide((forward * backward).sum(1), (forward**2 + backward**2).sum(1))
        k = np.nan_to_num(k)[:, None]
        last = a.copy()
        a[:, 1 : m + 2] += k * last[:, m::-1] if m else k * last[:, :1]
        forward, backward = (forward + k * backward)[:, 1:], (backward + k * forward)[:, :-1]
    return a


def formant_tracks(f: Frames) -> tuple[np.ndarray, np.ndarray]:
    c = f.config
    x = f.signal
    if c.formants_signal_preemphasis_from is not None:
        x = np.r_[x[:1], x[1:] - np.exp(-2 * np.pi * c.formants_signal_preemphasis_from / f.rate) * x[:-1]]
    frames = f._framed(x) * window(c.formants_window, c.frame_len)
    order = 2 * c.formants_max
    a = burg(frames, order)
    companion = np.zeros((len(a), order, order))
    companion[:, 0] = -a[:, 1:]
    companion[:, np.arange(1, order), np.arange(order - 1)] = 1
    roots = np.linalg.eigvals(companion) if len(a) else np.zeros((0, order), complex)
    with np.errstate(divide="ignore"):
        freq = np.angle(roots) * f.rate / (2 * np.pi)
        width = -np.log(np.abs(roots)) * f.rate / np.pi
    ok = (roots.imag > 0) & (freq >= c.formants_lower_freq) & (freq <= c.formants_upper_freq) & ((frames**2).sum(1) > 0)[:, None]
    freq, width = np.where(ok, freq, np.nan), np.where(ok, width, np.nan)
    rank = np.argsort(freq, axis=1)[:, : c.formants_max]  # NaN last
    return np.take_along_axis(freq, rank, 1), np.take_along_axis(width, rank, 1)


def _band(f: Frames, low: float, high: float) -> np.ndarray:
    return (f.freqs >= low) & (f.freqs < high)


def rms_db(f: Frames) -> np.ndarray:
    """Of the windowed frames, which is to say of the spectrum."""
    return _db(np.sqrt((f.windowed**2).mean(1)), 20.0)


def spectral_flux(f: Frames) -> np.ndarray:
    """Sum over frequencies of the squared change of magnitude; NaN for the first frame."""
    return np.r_[np.nan, (np.diff(f.magnitude, axis=0) ** 2).sum(1)]


def alpha_ratio(f: Frames) -> np.ndarray:
    low, high = (f.magnitude[:, _band(f, *b)].sum(1) for b in (f.config.alpha_ratio_lower_band, f.config.alpha_ratio_upper_band))
    return _db(_divide(low, high))


def hammarberg_index(f: Frames) -> np.ndarray:
    pivot = f.config.hammar_index_pivot_point_freq
    low, high = (f.magnitude[:, _band(f, *b)].max(1) for b in ((0, pivot), (pivot, f.config.hammar_index_upper_freq)))
    return _db(_divide(low, high))


def spectral_slope(low: float, high: float) -> Callable[[Frames], np.ndarray]:
    """Slope of a line fitted to the power in dB over the frequencies of a band, which is one of config.spectral_slopes_bands."""

    def feature(f: Frames) -> np.ndarray:
        if (low, high) not in {tuple(map(float, b)) for b in f.config.spectral_slopes_bands}:
            raise ValueError(f"no such band of slopes: {low} to {high}")
        band = _band(f, low, high)
        x = f.freqs[band] - f.freqs[band].mean()
        return (_db(f.magnitude[:, band], 20.0) @ x) / (x @ x)

    return feature


def mel_filters(f: Frames) -> np.ndarray:
    """Triangles of equal area on a scale that is linear to 1000 Hz and logarithmic above."""
    step, log_step = 200 / 3, np.log(6.4) / 27
    mel = lambda hz: hz / step if hz < 1000 else 15 + np.log(hz / 1000) / log_step
    c = f.config
    m = np.linspace(mel(c.mel_spec_lower_freq), mel(min(c.mel_spec_upper_freq, f.rate / 2)), c.mel_spec_n_mels + 2)
    edges = np.where(m < 15, m * step, 1000 * np.exp(log_step * (m - 15)))
    left, mid, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.clip(np.minimum((f.freqs - left) / (mid - left), (right - f.freqs) / (right - mid)), 0, None) * 2 / (right - left)


def mfcc(index: int) -> Callable[[Frames], np.ndarray]:
    """Column ``index`` of the cepstral coefficients, from 0."""
    return lambda f: f.mfccs[:, index]


def hnr_db(f: Frames) -> np.ndarray:
    """Harmonics-to-noise ratio from the height of the autocorrelation's greatest peak; NaN for silent frames."""
    low, high = _lags(f, f.config.hnr_lower_freq, f.rate / 2)
    part = np.nan_to_num(f.correlation[:, : high + 1], nan=-1.0)
    # the peak at lag 0 ends where the correlation is first negative
    first = np.where((part < 0).any(1), (part < 0).argmax(1), part.shape[1])
    later = np.where(np.arange(part.shape[1]) >= np.maximum(first, low)[:, None], part, -1.0)
    _, peak = _peak(part, later.argmax(1))
    quiet = np.abs(f.frames).max(1) < f.config.hnr_rel_silence_threshold * max(np.abs(f.signal).max(initial=0), 1e-12)
    ok = (later.max(1) > 0) & ~quiet
    peak = np.clip(peak, 1e-12, 1 - 1e-12)
    return np.where(ok, 10 * np.log10(peak / (1 - peak)), np.nan)


def formant(what: str, index: int) -> Callable[[Frames], np.ndarray]:
    """Frequency, bandwidth or amplitude of formant ``index``, from 0."""
    of = {"freq": lambda f: f.formants[0], "bandwidth": lambda f: f.formants[1], "amplitude": lambda f: f.formant_amplitudes}[what]
    return lambda f: of(f)[:, index]


def harmonic_difference(x: int = 0, y: int = 1, x_type: str = "h", y_type: str = "h") -> Callable[[Frames], np.ndarray]:
    """Difference in dB of two amplitudes, each that of a harmonic ("h") or of a formant ("f"), by index from 0."""
    for kind in (x_type, y_type):
        if kind not in ("h", "f"):
            raise ValueError(f"an amplitude is of a harmonic (h) or of a formant (f), not {kind!r}")

    def level(f: Frames, index: int, kind: str) -> np.ndarray:
        if kind == "h":
            return _db(f.harmonics[:, index], 20.0)
        return f.formant_amplitudes[:, index] + (_db(f.harmonics[:, 0], 20.0) if f.config.formants_amp_rel_f0 else 0)

    return lambda f: level(f, x, x_type) - level(f, y, y_type)


@dataclass(frozen=True)
class Feature:
    """A feature made from the intermediate results that it requires: names of Frames' attributes, passed by name."""

    function: Callable[..., np.ndarray]
    requires: tuple[str, ...]

    def __post_init__(self):
        for name in self.requires:
            if name not in ("signal", "rate", "config") and not isinstance(getattr(Frames, name, None), cached_property):
                raise TypeError(f"there is no intermediate result {name!r}")

    def __call__(self, f: Frames) -> np.ndarray:
        return self.function(**{name: getattr(f, name) for name in self.requires})


FEATURES: dict[str, Callable[[Frames], np.ndarray]] = {
    "pitch_f0_hz": lambda f: f.pitch, "jitter_local_rel_f0": jitter, "shimmer_local_rel_f0": shimmer, "hnr_db": hnr_db,
    **{f"f{i + 1}_{name}": formant(what, i) for i in range(3) for what, name in (("freq", "freq_hz"), ("bandwidth", "bandwidth_hz"), ("amplitude", "amplitude_rel_f0"))},
    "alpha_ratio_db": alpha_ratio, "hammar_index_db": hammarberg_index,
    "spectral_slope_0_500": spectral_slope(0, 500), "spectral_slope_500_1500": spectral_slope(500, 1500),
    "h1_h2_diff_db": harmonic_difference(), "h1_f3_diff_db": harmonic_difference(y=2, y_type="f"),
    **{f"mfcc_{k + 1}": mfcc(k) for k in range(4)}, "spectral_flux": spectral_flux, "rms_db": rms_db,
}


def check_features(features: dict[str, Callable]) -> None:
    for name, feature in features.items():
        if not isinstance(name, str):
            raise TypeError(f"the name of a feature is a str, not {name!r}")
        if not callable(feature):
            raise TypeError(f"feature {name} is no function of frames")


def extract(signals: DataFrame, features: dict[str, Callable[[Frames], np.ndarray]] | None = None, config: VoiceConfig | None = None) -> DataFrame:
    """The long table of signals (filename, rate, samples); NaN values are NULL."""
    features, config = FEATURES if features is None else features, config or VoiceConfig()
    check_features(features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for filename, rate, samples in zip(b["filename"], b["rate"], b["samples"], strict=True):
                f = frame(np.asarray(samples), float(rate), config)
                for name, feature in features.items():
                    yield pd.DataFrame({"filename": filename, "feature": name, "ts": f.times, "value": feature(f)})

    return signals.select("filename", "rate", "samples").mapInPandas(run, LONG)


def default_order(names: list[str]) -> list[str]:
    """Names in the order of the default features, others after them."""
    return [n for n in VOICE_FEATURES if n in names] + [n for n in names if n not in VOICE_FEATURES]
