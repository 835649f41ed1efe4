"""Streaming extras over the event stream: not in the reference, which resumes batches instead."""
