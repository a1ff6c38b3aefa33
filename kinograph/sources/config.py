"""Settings of voice features, validated, with YAML files."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

_POSITIVE = {
    "frame_len", "hop_len", "pitch_n_harmonics", "pitch_pulse_lower_period", "pitch_pulse_upper_period", "pitch_pulse_max_period_ratio",
    "pitch_pulse_max_amp_factor", "hnr_lower_freq", "hnr_rel_silence_threshold", "formants_max", "formants_amp_lower",
    "formants_amp_upper", "hammar_index_pivot_point_freq", "hammar_index_upper_freq", "mel_spec_n_mels", "mfcc_n",
}


@dataclass(frozen=True)
class VoiceConfig:
    frame_len: int = 1024
    hop_len: int = 256
    center: bool = True
    pad_mode: str = "constant"
    spec_window: str = "hann"
    pitch_lower_freq: float = 75.0
    pitch_upper_freq: float = 600.0
    pitch_method: str = "pyin"
    pitch_n_harmonics: int = 100
    pitch_pulse_lower_period: float = 1e-4
    pitch_pulse_upper_period: float = 0.02
    pitch_pulse_max_period_ratio: float = 1.3
    pitch_pulse_max_amp_factor: float = 1.6
    jitter_rel: bool = True
    shimmer_rel: bool = True
    hnr_lower_freq: float = 75.0
    hnr_rel_silence_threshold: float = 0.1
    formants_max: int = 5
    formants_lower_freq: float = 50.0
    formants_upper_freq: float = 5450.0
    formants_signal_preemphasis_from: float | None = None
    formants_window: str = "praat_gaussian"
    formants_amp_lower: float = 0.8
    formants_amp_upper: float = 1.2
    formants_amp_rel_f0: bool = True
    alpha_ratio_lower_band: tuple = (50.0, 1000.0)
    alpha_ratio_upper_band: tuple = (1000.0, 5000.0)
    hammar_index_pivot_point_freq: float = 2000.0
    hammar_index_upper_freq: float = 5000.0
    spectral_slopes_bands: tuple = ((0.0, 500.0), (500.0, 1500.0))
    mel_spec_n_mels: int = 26
    mel_spec_lower_freq: float = 20.0
    mel_spec_upper_freq: float = 8000.0
    mfcc_n: int = 4
    mfcc_lifter: float = 22.0

    def __post_init__(self):
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, list):
                v = tuple(tuple(x) if isinstance(x, list) else x for x in v)
                object.__setattr__(self, f.name, v)
            numbers = [y for x in (v if isinstance(v, tuple) else (v,)) for y in (x if isinstance(x, tuple) else (x,))]
            for x in numbers:
                if isinstance(x, bool) or not isinstance(x, (int, float)):
                    if f.name in _POSITIVE:
                        raise ValueError(f"{f.name} is a number, not {x!r}")
                elif x < 0 or (x == 0 and f.name in _POSITIVE):
                    raise ValueError(f"{f.name} is too small: {x}")

    @classmethod
    def read_yaml(cls, path: str) -> VoiceConfig:
        import yaml

        with open(path, encoding="utf-8") as f:
            return cls(**(yaml.safe_load(f) or {}))

    def write_yaml(self, path: str) -> None:
        import yaml

        plain = {k: [list(x) if isinstance(x, tuple) else x for x in v] if isinstance(v, tuple) else v for k, v in asdict(self).items()}
        with open(path, "w", encoding="utf-8") as f:
            yaml.safe_dump(plain, f, sort_keys=False)
