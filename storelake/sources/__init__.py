"""storelake.sources"""
