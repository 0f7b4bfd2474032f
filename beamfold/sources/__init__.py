"""Readers and writers: recordings, sidecars, waveforms, clouds, replay streams."""
