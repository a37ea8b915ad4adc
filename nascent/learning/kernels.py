"""Loss and gradient of the three models, on one minibatch.

Weights are one flat float64 vector, which is what Spark broadcasts and averages.
"""

from __future__ import annotations

import numpy as np


def unpack(flat: np.ndarray, shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
    parts, at = [], 0
    for shape in shapes:
        size = int(np.prod(shape))
        parts.append(flat[at : at + size].reshape(shape))
        at += size
    return parts


def pack(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([p.ravel() for p in parts])


def start_weights(shapes: list[tuple[int, ...]], fan_in: list[int], seed: int) -> np.ndarray:
    """Uniform in plus or minus one over the square root of the fan-in."""
    rng = np.random.default_rng(seed)
    return pack(
        [rng.uniform(-1, 1, shape) / np.sqrt(fan) for shape, fan in zip(shapes, fan_in, strict=True)]
    )


class DenseAutoencoder:
    """Mirror-shaped dense network; every layer but the latent and the last is rectified."""

    def __init__(self, dim: int, hidden: tuple[int, ...], latent: int) -> None:
        widths = [dim, *hidden, latent, *reversed(hidden), dim]
        self.depth = len(widths) - 1
        self.encoder_depth = len(hidden) + 1
        self.latent = latent
        self.shapes, self.fan_in = [], []
        for before, after in zip(widths[:-1], widths[1:], strict=True):
            self.shapes += [(before, after), (after,)]
            self.fan_in += [before, before]

    def initial(self, seed: int) -> np.ndarray:
        return start_weights(self.shapes, self.fan_in, seed)

    def _rectified(self, layer: int) -> bool:
        return layer not in (self.encoder_depth - 1, self.depth - 1)

    def forward(self, parts: list[np.ndarray], x: np.ndarray, layers: int) -> list[np.ndarray]:
        """Inputs of every layer followed by the final output."""
        values = [x]
        for layer in range(layers):
            out = values[-1] @ parts[2 * layer] + parts[2 * layer + 1]
            values.append(np.maximum(out, 0) if self._rectified(layer) else out)
        return values

    def backward(self, parts: list[np.ndarray], values: list[np.ndarray], slope: np.ndarray) -> list[np.ndarray]:
        """Gradients of the layers that produced ``values``, given that of the output."""
        grads: list[np.ndarray] = []
        for layer in reversed(range(len(values) - 1)):
            if self._rectified(layer):
                slope = slope * (values[layer + 1] > 0)
            grads = [values[layer].T @ slope, slope.sum(axis=0), *grads]
            slope = slope @ parts[2 * layer].T
        return grads

    def encode(self, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.forward(unpack(flat, self.shapes), x, self.encoder_depth)[-1]

    def row_errors(self, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
        rebuilt = self.forward(unpack(flat, self.shapes), x, self.depth)[-1]
        return ((rebuilt - x) ** 2).mean(axis=1)

    def loss_and_gradient(self, flat: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
        parts = unpack(flat, self.shapes)
        values = self.forward(parts, x, self.depth)
        gap = values[-1] - x
        return float((gap**2).mean()), pack(self.backward(parts, values, 2 * gap / gap.size))


def student_weights(z: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Soft assignments and the unnormalised kernel (one degree of freedom)."""
    squared = ((z[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
    kernel = 1.0 / (1.0 + squared)
    return kernel / kernel.sum(axis=1, keepdims=True), kernel


def sharpened(q: np.ndarray, frequency: np.ndarray) -> np.ndarray:
    raw = q**2 / frequency
    return raw / raw.sum(axis=1, keepdims=True)


class ClusteringModel:
    """Encoder of an autoencoder plus centroids, pulled towards sharpened assignments.

    The flat vector holds the whole autoencoder followed by the centroids; the decoder
    gets no gradient.
    """

    def __init__(self, network: DenseAutoencoder, k: int) -> None:
        self.network, self.k = network, k
        self.network_size = int(sum(np.prod(s) for s in network.shapes))

    def split(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        centres = flat[self.network_size :].reshape(self.k, self.network.latent)
        return flat[: self.network_size], centres

    def assign(self, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
        weights, centres = self.split(flat)
        return student_weights(self.network.encode(weights, x), centres)[0]

    def loss_and_gradient(self, flat: np.ndarray, x: np.ndarray, p: np.ndarray) -> tuple[float, np.ndarray]:
        weights, centres = self.split(flat)
        parts = unpack(weights, self.network.shapes)
        values = self.network.forward(parts, x, self.network.encoder_depth)
        z, n = values[-1], len(x)
        q, kernel = student_weights(z, centres)
        loss = float((p * (np.log(np.maximum(p, 1e-12)) - np.log(q + 1e-9))).sum() / n)
        pull = (p - q) * kernel
        slope = 2.0 / n * (pull.sum(axis=1, keepdims=True) * z - pull @ centres)
        centre_slope = -2.0 / n * (pull.T @ z - pull.sum(axis=0)[:, None] * centres)
        grads = self.network.backward(parts, values, slope)
        tail = np.zeros(self.network_size - sum(g.size for g in grads))
        return loss, np.concatenate([pack(grads), tail, centre_slope.ravel()])

    def tuner(self, flat: np.ndarray, rate: float) -> Tuner:
        return Tuner(self, flat, rate)


class Tuner:
    """Steps of a :class:`ClusteringModel` on one shard, equal to the last bit to those with
    ``loss_and_gradient`` and :class:`Adam` on the whole vector.

    The decoder, which has no gradient, takes no part; weights, gradients and the parts of a
    batch are views of arrays that are made once, and the loss is computed only when asked for.
    """

    def __init__(self, model: ClusteringModel, flat: np.ndarray, rate: float) -> None:
        network = model.network
        shapes = network.shapes[: 2 * network.encoder_depth]
        self.size = int(sum(np.prod(s) for s in shapes))
        self.network, self.start, self.tail = network, flat, model.network_size
        self.active = np.concatenate([flat[: self.size], flat[model.network_size :]])
        self.slope = np.empty_like(self.active)
        centres = (model.k, network.latent)
        *self.parts, self.centres = unpack(self.active, [*shapes, centres])
        *self.grads, self.centre_grad = unpack(self.slope, [*shapes, centres])
        self.adam = Adam(self.active.size, rate)
        self.spaces: dict[int, tuple] = {}

    def weights(self) -> np.ndarray:
        """The whole vector, with the weights as they are now."""
        flat = self.start.copy()
        flat[: self.size], flat[self.tail :] = self.active[: self.size], self.active[self.size :]
        return flat

    def _space(self, n: int) -> tuple:
        if n not in self.spaces:
            wide = [np.empty((n, part.shape[1])) for part in self.parts[::2]]
            self.spaces[n] = (
                [np.empty((n, len(self.parts[0]))), *wide], [np.empty_like(v) for v in wide],
                [np.empty(v.shape, dtype=bool) for v in wide], np.empty((n, *self.centres.shape)), np.empty((n, len(self.centres))),
            )
        return self.spaces[n]

    def step(self, x: np.ndarray, p: np.ndarray, rows: np.ndarray, with_loss: bool) -> float:
        """One step on some rows of a shard; their loss, or 0 where it is not asked for."""
        n, depth, parts = len(rows), self.network.encoder_depth, self.parts
        values, slopes, above, gaps, target = self._space(n)
        np.take(x, rows, axis=0, out=values[0], mode="clip")
        np.take(p, rows, axis=0, out=target, mode="clip")
        for layer in range(depth):
            out = np.matmul(values[layer], parts[2 * layer], out=values[layer + 1])
            out += parts[2 * layer + 1]
            if self.network._rectified(layer):
                np.maximum(out, 0, out=out)
        z = values[depth]
        np.subtract(z[:, None, :], self.centres[None, :, :], out=gaps)
        np.multiply(gaps, gaps, out=gaps)
        kernel = gaps.sum(axis=2)
        kernel += 1.0
        np.divide(1.0, kernel, out=kernel)
        q = kernel / kernel.sum(axis=1, keepdims=True)
        loss = 0.0
        if with_loss:
            loss = float((target * (np.log(np.maximum(target, 1e-12)) - np.log(q + 1e-9))).sum() / n)
        pull = np.subtract(target, q, out=q)
        pull *= kernel
        slope = np.multiply(pull.sum(axis=1, keepdims=True), z, out=slopes[-1])
        slope -= pull @ self.centres
        slope *= 2.0 / n
        np.matmul(pull.T, z, out=self.centre_grad)
        self.centre_grad -= pull.sum(axis=0)[:, None] * self.centres
        self.centre_grad *= -2.0 / n
        for layer in reversed(range(depth)):
            if self.network._rectified(layer):
                slope *= np.greater(values[layer + 1], 0, out=above[layer])
            np.matmul(values[layer].T, slope, out=self.grads[2 * layer])
            slope.sum(axis=0, out=self.grads[2 * layer + 1])
            if layer:
                slope = np.matmul(slope, parts[2 * layer].T, out=slopes[layer - 1])
        self.adam.step(self.active, self.slope)
        return loss


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _recur(x, wx, wh, b, h, c):
    """One recurrent layer over ``x`` (steps, rows, width); returns outputs and a tape."""
    tape, outputs = [], []
    for step in x:
        gates = step @ wx + h @ wh + b
        i, f, g, o = np.split(gates, 4, axis=1)
        i, f, g, o = _sigmoid(i), _sigmoid(f), np.tanh(g), _sigmoid(o)
        c_next = f * c + i * g
        t = np.tanh(c_next)
        tape.append((step, h, c, i, f, g, o, t))
        h, c = o * t, c_next
        outputs.append(h)
    return np.stack(outputs), tape


def _unroll(tape, wx, wh, slopes):
    """Backward pass of :func:`_recur`; ``slopes`` are those of the outputs."""
    dwx, dwh, db = np.zeros_like(wx), np.zeros_like(wh), np.zeros(wx.shape[1])
    dh = np.zeros_like(tape[0][1])
    dc = np.zeros_like(dh)
    dx = []
    for (step, h, c, i, f, g, o, t), slope in zip(reversed(tape), reversed(slopes), strict=True):
        dh = dh + slope
        dc = dc + dh * o * (1 - t * t)
        gates = np.concatenate(
            [dc * g * i * (1 - i), dc * c * f * (1 - f), dc * i * (1 - g * g), dh * t * o * (1 - o)], axis=1
        )
        dwx += step.T @ gates
        dwh += h.T @ gates
        db += gates.sum(axis=0)
        dx.append(gates @ wx.T)
        dh, dc = gates @ wh.T, dc * f
    return dwx, dwh, db, np.stack(dx[::-1]), dh


class SequenceAutoencoder:
    """Recurrent encoder to a latent vector, recurrent decoder back to the sequence."""

    def __init__(self, features: int, hidden: int, latent: int) -> None:
        self.hidden = hidden
        self.shapes = [
            (features, 4 * hidden), (hidden, 4 * hidden), (4 * hidden,),
            (hidden, latent), (latent,), (latent, hidden), (hidden,),
            (hidden, 4 * hidden), (hidden, 4 * hidden), (4 * hidden,),
            (hidden, features), (features,),
        ]
        self.fan_in = [hidden] * 3 + [hidden, hidden, latent, latent] + [hidden] * 5

    def initial(self, seed: int) -> np.ndarray:
        return start_weights(self.shapes, self.fan_in, seed)

    def _run(self, parts, x):
        wx, wh, b, w1, b1, w2, b2, vx, vh, vb, w3, b3 = parts
        zero = np.zeros((x.shape[1], self.hidden))
        encoded, tape = _recur(x, wx, wh, b, zero, zero)
        z = encoded[-1] @ w1 + b1
        start = z @ w2 + b2
        decoded, back_tape = _recur(np.repeat(start[None], len(x), axis=0), vx, vh, vb, start, zero)
        return encoded, tape, z, decoded, back_tape, decoded @ w3 + b3

    def rebuild(self, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
        """``x`` is (rows, steps, features)."""
        steps = x.transpose(1, 0, 2)
        return self._run(unpack(flat, self.shapes), steps)[-1].transpose(1, 0, 2)

    def loss_and_gradient(self, flat: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
        parts = unpack(flat, self.shapes)
        wx, wh, _, w1, _, w2, _, vx, vh, _, w3, _ = parts
        steps = x.transpose(1, 0, 2)
        encoded, tape, z, decoded, back_tape, rebuilt = self._run(parts, steps)
        gap = rebuilt - steps
        slope = 2 * gap / gap.size
        dw3 = np.einsum("tbh,tbf->hf", decoded, slope)
        db3 = slope.sum(axis=(0, 1))
        dvx, dvh, dvb, dinput, dstart = _unroll(back_tape, vx, vh, slope @ w3.T)
        dstart = dstart + dinput.sum(axis=0)
        dz = dstart @ w2.T
        tail = np.zeros_like(encoded)
        tail[-1] = dz @ w1.T
        dwx, dwh, db, _, _ = _unroll(tape, wx, wh, tail)
        grads = [
            dwx, dwh, db, encoded[-1].T @ dz, dz.sum(axis=0), z.T @ dstart, dstart.sum(axis=0),
            dvx, dvh, dvb, dw3, db3,
        ]
        return float((gap**2).mean()), pack(grads)


class Adam:
    """Step rule for one shard's local steps."""

    def __init__(self, size: int, rate: float) -> None:
        self.rate, self.m, self.v, self.t = rate, np.zeros(size), np.zeros(size), 0
        self.spare, self.fixed = np.empty(size), np.empty(size)

    def step(self, flat: np.ndarray, grad: np.ndarray) -> None:
        self.t += 1
        spare, fixed = self.spare, self.fixed
        np.subtract(grad, self.m, out=spare)
        spare *= 0.1
        self.m += spare
        np.multiply(grad, grad, out=spare)
        spare -= self.v
        spare *= 0.001
        self.v += spare
        np.divide(self.v, 1 - 0.999**self.t, out=fixed)
        np.sqrt(fixed, out=fixed)
        fixed += 1e-8
        np.divide(self.m, 1 - 0.9**self.t, out=spare)
        spare *= self.rate
        spare /= fixed
        flat -= spare
