"""Models for tests of stages and command lines."""


def decoder(content):
    return [(i, bytes([i])) for i in range(len(content))]


def detector(image):
    return [{"face_box": [0.0, 0.0, 9.0, 9.0], "face_prob": 0.9, "face_landmarks": [[1.0, 2.0]] * 5}] * (image[0] % 3)


def embedder(image, box):
    return [float(image[0]), 1.0]


def units(image, box):
    if image[0] == 4:
        raise KeyError("no units")
    return [0.5] * 41


def tracks(samples, rate):
    return [(0.0, 0.5, "SPEAKER_07"), (0.5, 0.75, "SPEAKER_02"), (0.75, 1.0, "SPEAKER_07")]


def recogniser(samples):
    if len(samples) < 5000:
        raise RuntimeError("too short")
    return "All well. Fine!", [{"start": 0.1 * i, "end": 0.1 * i + 0.05, "probability": 0.5} for i in range(3)]


def logits(text):
    if "Fine" in text:
        raise RuntimeError("no")
    return [0.0, 1.0, 2.0]
