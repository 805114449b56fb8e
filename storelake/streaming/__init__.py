"""storelake.streaming"""
